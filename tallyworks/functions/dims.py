"""Rate and rule dimensions: small fixed tables, as DataFrames and as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values. US dollars per million tokens: input, output, cache read, cache write 5 min, cache write 1 h.
PRICES = [
    ("m-max", 10.0, 50.0, 1.0, 12.5, 20.0, True),
    ("m-large", 5.0, 25.0, 0.5, 6.25, 10.0, True),
    ("m-mid", 3.0, 15.0, 0.3, 3.75, 6.0, True),
    ("m-small", 1.0, 5.0, 0.1, 1.25, 2.0, False),
]
PRICE_COLUMNS = ["model", "p_in", "p_out", "p_read", "p_5m", "p_1h", "verified"]

#: Fixed values. Watt hours per million tokens: base, low, high.
ENERGY = [
    ("large", "m-max", 450.0, 150.0, 1500.0),
    ("large", "m-large", 450.0, 150.0, 1500.0),
    ("mid", "m-mid", 300.0, 100.0, 1000.0),
    ("small", "m-small", 110.0, 30.0, 300.0),
]
ENERGY_COLUMNS = ["class", "model", "wh_base", "wh_low", "wh_high"]

#: Fixed values. Context multiplier by input plus cache read: above ``over``, up to ``up_to``; the last step has no end.
CURVE = [(-1, 10_000, 1.0), (10_000, 100_000, 1.0), (100_000, 500_000, 1.2), (500_000, None, 1.4)]
CURVE_COLUMNS = ["over", "up_to", "multiplier"]

#: Fixed values. Grams of CO2 equivalent per kWh.
GRID = [("world", 473.0, True), ("IN", 708.0, False), ("US", 350.0, False), ("EU", 213.0, False)]
GRID_COLUMNS = ["region", "g_per_kwh", "is_default"]

#: Fixed values of the scores.
WEIGHTS = {"context": 0.35, "output": 0.25, "cache": 0.25, "energy": 0.15}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
MIN_SCORES = 3
VERBOSE = 1500
SHAPES = [(0.2, "chat", 2.5), (0.6, "mixed", 8.0), (None, "agentic", 25.0)]
SPLIT_TOKENS = 120_000
SIZE_RATIO = 0.4
STATE_TOKENS = 600
REWRITE_BYTES = 16_384
GOVERN_BYTES = 131_072
TRIVIAL_CHARS = 120

#: Fixed values of lesson mining.
HALF_SATURATION = 2.0
HALF_LIFE_DAYS = 14.0
CONTRADICTION_PENALTY = 0.25
GRADUATE_AT = 0.5
WITHDRAW_BELOW = 0.3

#: Gates of profiles; nulls are not configured.
PROFILES = [
    ("build-log", "error", None, 1.0, 20, True, 0.4, 1),
    ("test-output", None, "code", 0.9, None, True, 0.5, None),
    ("doc-serve", None, "prose", 1.0, 40, None, 0.6, 200),
    ("generic-stdout", None, None, None, None, False, 0.4, None),
]
PROFILE_COLUMNS = ["profile", "relevant_pattern", "entity_set", "least_ratio", "line_limit", "verdict", "most_ratio", "least_bytes"]

_TABLES = {
    "profiles": (PROFILES, PROFILE_COLUMNS, "profile string, relevant_pattern string, entity_set string, least_ratio double, line_limit long, verdict boolean, most_ratio double, least_bytes long"),
    "prices": (PRICES, PRICE_COLUMNS, "model string, p_in double, p_out double, p_read double, p_5m double, p_1h double, verified boolean"),
    "energy": (ENERGY, ENERGY_COLUMNS, "class string, model string, wh_base double, wh_low double, wh_high double"),
    "curve": (CURVE, CURVE_COLUMNS, "over long, up_to long, multiplier double"),
    "grid": (GRID, GRID_COLUMNS, "region string, g_per_kwh double, is_default boolean"),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    rows, _, schema = _TABLES[name]
    return spark.createDataFrame(rows, schema)


def values_sql(name: str) -> str:
    """The same table as a SELECT that DuckDB runs."""
    rows, columns, schema = _TABLES[name]
    kinds = [part.strip().split(" ")[1] for part in schema.split(",")]
    kinds = [{"string": "VARCHAR", "long": "BIGINT"}.get(k, k.upper()) for k in kinds]
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    selects = [
        "SELECT " + ", ".join(f"CAST({text(v)} AS {k}) AS {c}" for v, k, c in zip(row, kinds, columns)) for row in rows
    ]
    return " UNION ALL ".join(selects)


#: Suffixes with a skeleton, limits of writes and prompts, thresholds of a repository's posture.
CODE_SUFFIXES = ("ts", "tsx", "mts", "js", "mjs", "cjs", "jsx", "py")
DOCUMENT_SUFFIXES = ("md", "markdown", "txt", "text", "pdf", "docx")
PAGE_SUFFIXES = ("html", "htm")
FULL_REWRITE_BYTES = 16_384
#: Tool names by which a session shows that it was served: any server's zoom.
OWN_TOOLS = r"(^|__)zoom($|_)"
#: Sizes of file reads that pass, that are capped, and that are governed in any posture.
READ_PASS, READ_CAPPED, GOVERN_ANY = 16_384, 65_536, 131_072
TRIVIAL_PROMPT_CHARS = 120
IDLE_FILES, IDLE_BYTES = 25, 262_144
LIGHT_FILES, LIGHT_BYTES = 120, 2_097_152


def posture(files, size, knowledge):
    """Posture of a repository by files, source bytes and learned entries: full, idle or light."""
    from pyspark.sql import functions as F

    full = (files > LIGHT_FILES) | (size > LIGHT_BYTES)
    return F.when(full, "full").when((knowledge == 0) & (files <= IDLE_FILES) & (size <= IDLE_BYTES), "idle").otherwise("light")


def validated(rates: DataFrame, base: str, low: str, high: str) -> DataFrame:
    """Rate rows with ``valid``: all three present, not negative, and low <= base <= high."""
    from pyspark.sql import functions as F

    ordered = (F.col(low) >= 0) & (F.col(low) <= F.col(base)) & (F.col(base) <= F.col(high))
    return rates.withColumn("valid", F.coalesce(ordered, F.lit(False)))


#: Rate tables that may be given as files: the key, the figures that must be there and not negative, and the one that must lie between others.
RATE_FILES = {
    "prices": ("model", ["p_in", "p_out", "p_read", "p_5m", "p_1h"], None),
    "energy": ("model", ["wh_base", "wh_low", "wh_high"], ("wh_low", "wh_base", "wh_high")),
    "grid": ("region", ["g_per_kwh"], None),
}


def load_rates(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A rate table of ``name`` (prices, energy or grid) from JSON lines, with the source that each row must name.

    Raises ValueError that tells the first bad rows and why: no key, a key twice,
    no source, a figure that is missing, not a number or negative, bands out of
    order, an unknown field. The file is read by Spark; the checks are one aggregate.
    """
    from pyspark.sql import functions as F

    key, figures, band = RATE_FILES[name]
    schema = _TABLES[name][2] + ", source string"
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    given = [f.name for f in spark.read.json(path).schema.fields]
    unknown = sorted(set(given) - {x.split()[0] for x in schema.split(", ")} - {"_corrupt_record"})
    if unknown:
        raise ValueError(f"{path}: unknown fields {', '.join(unknown)}")
    why = F.when(F.col("_bad").isNotNull(), "not a row of the table").when(F.coalesce(F.trim(key), F.lit("")) == "", f"no {key}")
    why = why.when(F.coalesce(F.trim("source"), F.lit("")) == "", "no source")
    for c in figures:
        why = why.when(~F.coalesce(F.col(c) >= 0, F.lit(False)), f"{c} is missing or negative")
    if band is not None:
        low, base, high = (F.col(c) for c in band)
        why = why.when(~((low <= base) & (base <= high)), f"{', '.join(band)} are out of order")
    rows = rows.cache()  # Spark reads no corrupt-record column alone
    bad = [f"{r[0]}: {r[1]}" for r in rows.select(F.coalesce(key, F.lit("a row")).alias("k"), why.alias("why")).where("why IS NOT NULL").orderBy("k").limit(5).collect()]
    bad += [f"{r[0]}: stands {r[1]} times" for r in rows.groupBy(key).count().where(f"count > 1 AND {key} IS NOT NULL").orderBy(key).limit(5).collect()]
    rows.unpersist()
    if bad:
        raise ValueError(f"{path}: " + "; ".join(bad))
    return rows.drop("_bad")
