"""Entity resolution on Spark: normalise, block, compare, decide, in DataFrame plans."""
