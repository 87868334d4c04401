"""Token counts by a tokenizer of the `tokenizers` or `sentencepiece` library; only lengths leave the workers.

For the .json vocabularies here (white space separates pre-tokens and is dropped) a text is cut at every ASCII white
space: no pre-token, special token or canonical composition crosses one, so that counts of the pieces add up. Pieces
that repeat are encoded once a worker (its memory is bounded, and cleared when full), new ones in batches of
about equal bytes. Where a vocabulary gives white space a meaning, texts are encoded whole, in batches of about equal
bytes.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, lengths, prepare, slices

REMEMBERED = 300_000
BATCH_BYTES = 1 << 18


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splits_at_space(path: str) -> bool:
    """Whether counts add up over pieces between white space: the pre-tokenizer drops white space, and neither the
    normaliser nor an added token can join what it parts."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def steps(x: dict | None, of: str) -> list[dict]:
        return [] if not x else x[of] if x["type"] == "Sequence" else [x]

    pre, norm = steps(spec["pre_tokenizer"], "pretokenizers"), steps(spec["normalizer"], "normalizers")
    dropping = any(p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"] and r"^\s" in p["pattern"].get("Regex", "") for p in pre)
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " " for x in norm)
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in spec["added_tokens"])
    return dropping and plain and added and all(x["type"] in ("Split", "ByteLevel") and not x.get("add_prefix_space") for x in pre)


class Counter:
    """Counts tokens with one library object; made once a worker and vocabulary."""

    def __init__(self, path: str):
        self.additive = splits_at_space(path)
        self.known: dict[bytes, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import os

            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            encode = getattr(model, "encode_batch_fast", model.encode_batch)
            self.encode = lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)]

    def batches(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= BATCH_BYTES:
                out += self.encode(texts[at : i + 1])
                at, size = i + 1, 0
        return out + (self.encode(texts[at:]) if at < len(texts) else [])

    def count(self, column: pa.Array) -> np.ndarray:
        if not self.additive:
            return np.array(self.batches([x or "" for x in column.to_pylist()]), np.int64)
        words = Words(column)
        if not len(words):
            return np.zeros(len(column), np.int64)
        coded = words.array().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, self.batches([p.decode() for p in new]), strict=True))
        each = np.fromiter((self.known[p] for p in pieces), np.int64, len(pieces))
        total = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])])
        return total[words.doc[1:]] - total[words.doc[:-1]]


@functools.lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary_path: str, text: str = "text", limit: int = 2048, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of every row, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and tokens. Repeated rows each get their row, whatever the ids; other columns
    are left unread. An empty table gives no rows."""
    prepare(docs.sparkSession)
    schema = docs.select(*carry).schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary_path)
        for batch in batches:
            column = batch.column(len(carry))
            for a, b in slices(column):
                part = column.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(carry)]), pa.array(lengths(part)), pa.array(own.count(part))], names=schema.names)

    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
