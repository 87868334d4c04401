"""Candidates: blocking keys with caps, TF-IDF legs, both directions, scores, and the reports about them.

Keys are equi-joined on (country, key). Cosines are added up block by block (vectorize.met), where the pairs that keys found
are told apart too, so that of all pairs with a common term only those that a leg takes are ever written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import LEG_FLAGS, BlockingConfig
from tidemark.functions.similarity import metaphone_code, soundex_code
from tidemark.functions.text import words
from tidemark.operators import vectorize
from tidemark.workers import written

WORD, CHAR, ADDRESS, EXACT, PIN, PHONETIC, EMBEDDING, BOTH_WAYS = LEG_FLAGS.values()


def _at_least(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, c).otherwise("")


def first_number(c: str = "address_numbers") -> Column:
    return F.coalesce(F.get(F.split(c, r"\|", -1), F.lit(0)), F.lit(""))


def sibling_key() -> Column:
    digits = F.filter(F.split("address_numbers", r"\|", -1), lambda t: t.rlike("^[0-9]+$"))
    return F.array_join(F.array_sort(F.array_distinct(digits)), "|")


def key_columns(legs: tuple[int, ...] = (EXACT, ADDRESS, PIN, PHONETIC)) -> list[tuple[int, int, Column]]:
    """(leg, kind, key) of a normalised record; an empty key is none."""
    core, number, tokens, address = F.trim("name_core"), first_number(), F.col("name_tokens"), F.trim("address_norm")
    parts = F.filter(F.split(tokens, r"\|", -1), lambda t: t != "")
    start = F.array_join(F.slice(words(address), 1, 2), " ")
    head = F.coalesce(F.get(words(core), F.lit(0)), F.lit(""))
    spoken = F.length(head) >= 3
    keys = [
        (EXACT, 1, _at_least(core, 3)),
        (EXACT, 2, F.when((number != "") & (F.length(core) >= 3), F.concat(core, F.lit("|"), number)).otherwise("")),
        (EXACT, 3, _at_least(tokens, 3)),
        (EXACT, 4, F.when(F.size(parts) >= 2, F.array_join(F.transform(parts, lambda t: F.substr(t, F.lit(1), F.lit(1))), "")).otherwise("")),
        (ADDRESS, 5, _at_least(address, 12)),
        (ADDRESS, 6, F.when((number != "") & (start != ""), F.concat(number, F.lit("|"), start)).otherwise("")),
        (PIN, 7, F.when(F.trim("address_pin").rlike("^[0-9]{5,6}$"), F.trim("address_pin")).otherwise("")),
        (PHONETIC, 8, F.when(spoken, soundex_code(head)).otherwise("")),
    ]
    if PHONETIC in legs:
        keys.append((PHONETIC, 9, F.when(spoken, metaphone_code(head)).otherwise("")))
    return [k for k in keys if k[0] in legs]


def alternative_key_columns() -> list[tuple[int, int, Column]]:
    """Keys of the alternative normaliser's records, each kind a leg of its own."""
    first2 = F.array_join(F.slice(words(F.col("name_core")), 1, 2), " ")
    house, street = F.col("house_no"), F.col("street")
    return [
        (1, 1, _at_least(F.col("name_nospace"), 5)),
        (2, 2, F.when(F.contains("name_sorted", F.lit(" ")), F.col("name_sorted")).otherwise("")),
        (4, 3, F.when((house != "") & (first2 != ""), F.concat(first2, F.lit("|"), house)).otherwise("")),
        (8, 4, _at_least(F.col("addr_norm"), 12)),
        (16, 5, F.when((house != "") & (street != ""), F.concat(house, F.lit("|"), street)).otherwise("")),
    ]


def key_table(records: DataFrame, keys: list[tuple[int, int, Column]]) -> DataFrame:
    """country, entity_id, leg, kind, key: a row for each key that a record has."""
    rows = F.array(*[F.struct(F.lit(leg).alias("leg"), F.lit(kind).alias("kind"), F.coalesce(key, F.lit("")).alias("key")) for leg, kind, key in keys])
    return records.select("country", "entity_id", F.explode(rows).alias("k")).select("country", "entity_id", "k.*").where("key <> ''")


def capped(gallery_keys: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """Gallery keys without those of over bucket_cap rows; of the others the first bucket_rows rows. The size of a key is an
    aggregate, so that partial sums precede the exchange, and large keys go before any window sorts them."""
    sizes = gallery_keys.groupBy("country", "kind", "key").agg(F.count("*").alias("size")).where(F.col("size") <= config.bucket_cap).drop("size")
    rank = F.row_number().over(Window.partitionBy("country", "kind", "key").orderBy("entity_id"))
    return gallery_keys.join(sizes, ["country", "kind", "key"]).withColumn("rank", rank).where(F.col("rank") <= config.bucket_rows).drop("rank")


def key_pairs(s1: DataFrame, gallery: DataFrame, keys: list[tuple[int, int, Column]] | None = None, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """country, s1, g, leg: pairs that share a key, at most rows_per_leg of an S1 record and leg, before repeated pairs are taken together."""
    keys = keys if keys is not None else key_columns()
    g = capped(key_table(gallery, keys), config).select("country", "leg", "key", F.col("kind").alias("g_kind"), F.col("entity_id").alias("g"))
    q = key_table(s1, keys).select("country", "leg", "key", "kind", F.col("entity_id").alias("s1"))
    met = q.join(g, ["country", "leg", "key"])
    if not config.cross_kind_keys:
        met = met.where("kind = g_kind")
    rank = F.row_number().over(Window.partitionBy("country", "s1", "leg").orderBy("kind", "g_kind", "g"))
    return met.withColumn("rank", rank).where(F.col("rank") <= config.rows_per_leg).select("country", "s1", "g", "leg")


def word_weights(s1: DataFrame, gallery: DataFrame, config: BlockingConfig = BlockingConfig()) -> tuple[DataFrame, DataFrame]:
    return vectorize.tfidf_weights(s1, gallery, vectorize.word_terms, config.word_max_df, config.max_df_rows)


def char_weights(s1: DataFrame, gallery: DataFrame, config: BlockingConfig = BlockingConfig()) -> tuple[DataFrame, DataFrame]:
    return vectorize.tfidf_weights(s1, gallery, lambda r: vectorize.char_terms(F.col("name_norm")), config.char_max_df, config.max_df_rows, min_df=2)


def phonetic_weights(s1: DataFrame, gallery: DataFrame, config: BlockingConfig = BlockingConfig()) -> tuple[DataFrame, DataFrame]:
    """Vectors over the Metaphone codes of words; each different word is coded once."""
    def coded(records: DataFrame) -> DataFrame:
        each = records.select("country", "entity_id", F.explode(words(F.col("name_core"))).alias("w"))
        codes = each.select("w").distinct().withColumn("term", metaphone_code(F.col("w")))
        return each.join(codes, "w").groupBy("country", "entity_id", "term").agg(F.count("*").alias("tf"))

    counts = coded(gallery)
    kept = written(vectorize.gallery_terms(gallery, counts, config.word_max_df, config.max_df_rows))
    return vectorize.weights(coded(s1), kept), vectorize.weights(counts, kept)


def scored_pairs(s1: DataFrame, gallery: DataFrame, keys: list[tuple[int, int, Column]] | None = None, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """country, s1, g, legs, word_cos, char_cos, blocking_score of every pair that a leg found."""
    vectors = [word_weights(s1, gallery, config), char_weights(s1, gallery, config)]
    best, bits = [(config.word_threshold, config.word_top), (config.char_threshold, config.char_top)], [WORD, CHAR]
    if config.phonetic_top:
        vectors.append(phonetic_weights(s1, gallery, config))
        best.append((config.phonetic_threshold, config.phonetic_top))
        bits.append(PHONETIC)
    back = (config.bidirectional_threshold, config.bidirectional_top)
    # written, so that the shuffled copies of the gallery are gone before pairs are ranked and joined
    met = written(vectorize.met(vectors, best, back, key_pairs(s1, gallery, keys, config)))
    # pairs that may be a gallery record's best come from every block
    first = Window.partitionBy("country", "g", "back").orderBy(F.desc(F.col("cos")[0]), "s1")
    both = F.when(F.col("back") & (F.row_number().over(first) <= back[1]), BOTH_WAYS).otherwise(0)
    legs = F.col("given").bitwiseOR(both)
    for k, bit in enumerate(bits):
        legs = legs.bitwiseOR(F.when(F.col("legs").bitwiseAND(1 << k) > 0, bit).otherwise(0))
    cos = [F.col("cos")[k] for k in range(len(vectors))] + [F.lit(0.0)]
    pairs = met.select("country", "s1", "g", legs.alias("legs"), cos[0].alias("word_cos"), cos[1].alias("char_cos"), cos[2].alias("phon_cos")).where("legs > 0")
    return pairs.withColumn("blocking_score", blocking_score(config))


def has(bit: int, legs: str = "legs") -> Column:
    return F.col(legs).bitwiseAND(bit) > 0


def blocking_score(config: BlockingConfig = BlockingConfig()) -> Column:
    kinds = has(EXACT).cast("int") + has(ADDRESS).cast("int") + has(PIN).cast("int")
    return F.round(F.col("word_cos") + F.col("char_cos") + config.phonetic_weight * F.col("phon_cos") + 0.25 * kinds + 0.15 * has(BOTH_WAYS).cast("int"), 9)


def best(pairs: DataFrame, k: int, score: str = "blocking_score") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("country", "s1").orderBy(F.desc(score), "g"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def as_candidates(pairs: DataFrame) -> DataFrame:
    """Scored pairs in the contract of candidates."""
    return pairs.select(
        F.col("s1").alias("source1_entity_id"), F.col("g").alias("candidate_entity_id"), F.substr("g", F.lit(1), F.lit(2)).alias("candidate_source"), "country",
        *[has(bit).alias(name) for name, bit in LEG_FLAGS.items()], F.bit_count("legs").cast("long").alias("num_legs_retrieved"), "blocking_score",
    )


def generate_candidates(s1: DataFrame, gallery: DataFrame, ground_truth: DataFrame | None = None, keys: list[tuple[int, int, Column]] | None = None, config: BlockingConfig = BlockingConfig(), pruner=None) -> DataFrame:
    """The best max_candidates pairs of each S1 record. ground_truth (source1_entity_id, candidate_entity_id) adds is_true_match. pruner:
    a function of pairs (country, s1, g, legs, cosines) that returns them with a probability as blocking_score; it re-ranks the
    best union_k pairs and brings in siblings."""
    pairs = scored_pairs(s1, gallery, keys, config)
    if pruner is not None:
        pool = pruner(best(pairs, max(config.union_k, config.max_candidates)))
        more = siblings(pool.where(F.col("blocking_score") >= config.sibling_seed), pool, gallery, config)
        more = more.withColumns({"legs": F.lit(ADDRESS), "word_cos": F.lit(0.0), "char_cos": F.lit(0.0), "phon_cos": F.lit(0.0)})
        pairs = pool.unionByName(pruner(more), allowMissingColumns=True)
    out = as_candidates(best(pairs, config.max_candidates))
    return out if ground_truth is None else labelled(out, ground_truth)


def siblings(seeds: DataFrame, have: DataFrame, gallery: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """country, s1, g: gallery records with the numeric address key of a confident candidate that aren't pairs yet."""
    keyed = gallery.select("country", F.col("entity_id").alias("g"), sibling_key().alias("key")).where("key <> ''")
    sizes = keyed.groupBy("country", "key").agg(F.count("*").alias("n")).where(F.col("n") <= config.sibling_cap).drop("n")
    table = keyed.join(sizes, ["country", "key"])
    asked = seeds.select("country", "s1", "g").join(keyed, ["country", "g"]).select("country", "s1", "key").distinct()
    found = asked.join(table, ["country", "key"]).select("country", "s1", "g").distinct()
    return found.join(have.select("country", "s1", "g"), ["country", "s1", "g"], "left_anti")


def labelled(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    true = truth.select("source1_entity_id", "candidate_entity_id").distinct().withColumn("_t", F.lit(True))
    return candidates.join(true, ["source1_entity_id", "candidate_entity_id"], "left").withColumn("is_true_match", F.coalesce("_t", F.lit(False))).drop("_t")


def adaptive_k(candidates: DataFrame, k_min: int = 5, gap: float = 0.1, k_max: int = 30, by: str = "source1_entity_id", score: str = "blocking_score", item: str = "candidate_entity_id") -> DataFrame:
    """The first k_min candidates, and those within `gap` of the best, k_max at most."""
    w = Window.partitionBy(by)
    rank = F.row_number().over(w.orderBy(F.desc(score), item))
    out = candidates.withColumns({"_rank": rank, "_best": F.max(score).over(w)})
    return out.where((F.col("_rank") <= k_max) & ((F.col("_rank") <= k_min) | (F.col(score) >= F.col("_best") - F.lit(gap + 1e-9)))).drop("_rank", "_best")


def recall_report(candidates: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """country (null: all), truth_pairs, hits, recall, average and most candidates of an S1 record."""
    pairs = truth.join(s1.select(F.col("entity_id").alias("source1_entity_id"), "country"), "source1_entity_id")
    found = candidates.select("source1_entity_id", "candidate_entity_id").withColumn("_hit", F.lit(1))
    hits = pairs.join(found, ["source1_entity_id", "candidate_entity_id"], "left").rollup("country").agg(F.count("*").alias("truth_pairs"), F.count("_hit").alias("hits"))
    each = candidates.groupBy("country", "source1_entity_id").agg(F.count("*").alias("n")).rollup("country").agg(F.avg("n").alias("avg_candidates"), F.max("n").alias("max_candidates"))
    each = each.withColumnRenamed("country", "_c")
    return hits.join(each, F.col("country").eqNullSafe(F.col("_c")), "left").select("country", "truth_pairs", "hits", F.round(F.try_divide("hits", "truth_pairs"), 6).alias("recall"), F.round("avg_candidates", 6).alias("avg_candidates"), "max_candidates")


def recall_at(candidates: DataFrame, truth: DataFrame, cuts: tuple[int, ...] = (1, 5, 10, 30)) -> DataFrame:
    """k, hits, recall: truth pairs among the best k candidates."""
    rank = F.row_number().over(Window.partitionBy("source1_entity_id").orderBy(F.desc("blocking_score"), "candidate_entity_id"))
    ranked = candidates.select("source1_entity_id", "candidate_entity_id", rank.alias("rank"))
    sums = truth.join(ranked, ["source1_entity_id", "candidate_entity_id"], "left").agg(F.count("*").alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in cuts])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in cuts])
    return sums.select("n", F.explode(rows).alias("r")).select("r.k", "r.hits", F.round(F.try_divide("r.hits", "n"), 6).alias("recall"))


def leg_hit_rates(candidates: DataFrame, cut: int = 5) -> DataFrame:
    """Each leg's share of candidates, among the best `cut` of an S1 record and the rest."""
    rank = F.row_number().over(Window.partitionBy("source1_entity_id").orderBy(F.desc("blocking_score"), "candidate_entity_id"))
    return candidates.withColumn("near_top", rank <= cut).groupBy("near_top").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c).cast("int")), 6).alias(c) for c in LEG_FLAGS])
