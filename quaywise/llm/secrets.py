"""Secrets: fixed patterns, and tokens that a character Markov model of random strings explains better than one of ordinary
identifiers. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind -> (pattern, group whose length counts, least length). Order is the order of kinds at one start.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # as [0-9a-f]+ of 16 or more: both take whole runs
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Tokens that the model judges: whole runs of the alphabet, of at least so many characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: A token is a secret if its log-likelihood ratio exceeds both, in all and for each transition.
LEAST_TOTAL, LEAST_MEAN = 10.0, 0.55
#: Documents whose words train the model of ordinary identifiers, about, and random strings that train the other.
TRAIN_DOCS, TRAIN_RANDOM = 2000, 6000

#: Ordinary identifiers as they stand in source code and configuration, labelled by hand.
IDENTIFIERS = """
getElementById addEventListener setRequestHeader createTextNode parseInt toLowerCase isNullOrEmpty hashCodeBuilder
AbstractSingletonProxyFactoryBean IllegalArgumentException NullPointerException BufferedInputStream ConcurrentHashMap
HttpServletRequest RequestMappingHandlerAdapter ThreadPoolExecutor SimpleDateFormat StringBuilder MainActivity
max_connections_per_host user_profile_settings read_timeout_seconds default_retry_policy content_security_policy
current_timestamp_utc first_name last_updated_at number_of_partitions shuffle_partition_size memory_overhead_factor
MAX_CONNECTIONS_PER_HOST DEFAULT_BUFFER_SIZE AWS_SECRET_ACCESS_KEY DATABASE_URL LOG_LEVEL_WARNING PYTHON_VERSION
margin-top background-color text-align-center nav-bar-inverse font-family-monospace grid-template-columns
src/main/resources/templates usr/local/share/applications home/user/projects/website/static/images var/log/messages
utf8mb4_unicode_ci sha256sum x86_64-linux-gnu python3-distutils libstdc++6 base64_encode iso8859-1 windows-1252
vec3_normalize md5_hex_digest int32_t uint64_t version-2-0-1 release-2024-01-15 chapter_10_section_3 step2_final_v3
""".split()


def _training(spark: SparkSession, docs: DataFrame, text: str, train_docs: int, train_random: int) -> DataFrame:
    """Labelled samples: (random, token)."""
    draw = F.concat_ws("-", F.lit("sample"), F.col("id"))
    raw = F.unhex(F.sha2(draw, 256))
    kinds = [
        F.base64(raw), F.translate(F.base64(raw), "+/", "-_"), F.sha2(draw, 256), F.upper(F.sha2(draw, 256)),
        F.translate(F.base64(raw), "+/=abcdefghijklmnopqrstuvwxyz", "XQ"), F.translate(F.upper(F.base64(raw)), "+/=", "XQ"),
        F.translate(F.base64(raw), "+/=", ""), F.translate(F.lower(F.base64(raw)), "+/=", ""),
    ]
    pick = F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int"))
    noise = spark.range(train_random, numPartitions=1).select(F.lit(True).alias("random"), F.translate(pick, "=", "").alias("token"))
    texts = docs.select(F.col(text).alias("t")).filter(F.col("t").isNotNull())
    n = max(1, texts.count())
    taken = texts.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) / float(1 << 20) < train_docs / n).distinct()
    word = taken.select(F.explode(F.regexp_extract_all("t", F.lit("(?<![A-Za-z])[A-Za-z]{5,}+"), F.lit(0))).alias("w"))
    spellings = F.array("w", F.upper("w"), F.concat(F.initcap("w"), F.initcap("w")), F.concat_ws("_", F.lower("w"), F.lower("w")))
    words = word.select(F.lit(False), F.explode(spellings))
    named = spark.range(40, numPartitions=1).select(F.lit(False), F.explode(F.array(*map(F.lit, IDENTIFIERS))))
    return noise.union(words).union(named)


def fit_model(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS, train_random: int = TRAIN_RANDOM) -> list[float]:
    """Log-likelihood ratios of character transitions, row-major over ALPHABET: random strings against identifiers.

    Trained from labelled samples: digests in several encodings are random; words of about ``train_docs`` documents (taken
    while a hash of the text lies below its share) in common spellings and IDENTIFIERS are ordinary. Both are counted by
    one aggregation, and the driver gets at most two rows a transition.
    """
    tokens = _training(docs.sparkSession, docs, text, train_docs, train_random).filter(F.length("token") > 1)
    pairs = F.expr("zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> concat(a, b))")
    counts = tokens.select("random", F.split("token", "").alias("c")).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count().collect()
    n = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    seen = {kind: [[0.5] * n for _ in range(n)] for kind in (True, False)}
    for kind, two, k in counts:
        if two[0] in place and two[1] in place:
            seen[kind][place[two[0]]][place[two[1]]] += k
    share = {kind: [[x / sum(row) for x in row] for row in rows] for kind, rows in seen.items()}
    return [math.log(share[True][i][j] / share[False][i][j]) for i in range(n) for j in range(n)]


def _pieces(text: str, pattern: str) -> str:
    """SQL: for each match the text from the previous match's end to this match's end."""
    whole = r"\G[\s\S]*?(?:" + pattern + ")"
    return f"CASE WHEN {text} RLIKE {_q(pattern)} THEN regexp_extract_all({text}, {_q(whole)}, 0) ELSE array() END"


def _q(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


#: Elements that running values are built over at once, so that they cost little more than their number.
_RUN = 256


def _running(df: DataFrame, out: str, values: Column, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """Add ``out``: for each value of an array (of ints from 0) the merge of all up to it: within runs of _RUN first, then over the runs' ends."""
    zero = F.array(F.lit(0))

    def grow(a: Column, x: Column) -> Column:
        return F.concat(a, F.array(merge(F.element_at(a, -1), x)))

    df = df.withColumn("_q_values", values)
    starts = F.when(F.size("_q_values") > 0, F.sequence(F.lit(1), F.size("_q_values"), F.lit(_RUN))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda at: F.aggregate(F.slice("_q_values", at, F.lit(_RUN)), zero, grow, lambda a: F.slice(a, F.lit(2), F.size(a))))
    df = df.withColumn("_q_runs", runs)
    df = df.withColumn("_q_before", F.aggregate(F.transform("_q_runs", lambda r: F.element_at(r, -1)), zero, grow))
    found = F.flatten(F.zip_with("_q_runs", F.slice("_q_before", F.lit(1), F.size("_q_runs")), lambda r, b: F.transform(r, lambda x: merge(b, x))))
    return df.withColumn(out, found).drop("_q_values", "_q_runs", "_q_before")


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _spans(df: DataFrame, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """Add ``_q_<kind>``: array of (start, rank, kind, end, token) of the matches in _q_text that are long enough, in code points."""
    pieces = f"_q_{kind}_pieces"
    df = df.withColumn(pieces, F.expr(_pieces("_q_text", pattern)))
    df = _running(df, "_q_ends", F.transform(pieces, F.length), _plus)

    def span(s: Column, end: Column) -> Column:
        token = F.regexp_extract(s, pattern, 0)
        long_enough = F.length(F.regexp_extract(s, pattern, group)) >= least
        return F.when(long_enough, F.struct((end - F.length(token)).alias("start"), F.lit([*BASE, "markov"].index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), token.alias("token")))

    found = F.zip_with(pieces, "_q_ends", span)
    return df.withColumn(f"_q_{kind}", F.filter(found, lambda x: x.isNotNull())).drop(pieces, "_q_ends")


def find_secrets(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """Add ``secrets``: array of (start, rank, kind, end), by start, then kind as listed; code points, end exclusive.

    Kinds assign, access and hex are leftmost, non-overlapping matches of fixed patterns; kind markov is a token that the
    model finds random and that overlaps none of them: sorted by start, no base span before it ends after its start, and
    the next base span starts no earlier than it ends. Null and empty texts have none; a very long text costs time in proportion
    to its length and the logarithm of its spans; repeated rows and empty tables give as many rows; every row keeps its columns, a column
    named ``secrets`` is replaced, and names that begin with ``_q_`` are reserved.
    """
    if clash := [c for c in docs.columns if c.startswith("_q_")]:
        raise ValueError(f"{clash} are reserved names")
    out = docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
    for kind, (pattern, group, least) in BASE.items():
        out = _spans(out, kind, pattern, group, least)
    out = _spans(out, "markov", CANDIDATE, 0, 20)

    def random(x: Column) -> Column:
        total = _score(x["token"], model)
        return (total > LEAST_TOTAL) & (total > LEAST_MEAN * (F.length(x["token"]) - 1))

    out = out.withColumn("_q_all", F.array_sort(F.concat(*[F.col(f"_q_{k}") for k in BASE], "_q_markov"))).withColumn("_q_size", F.length("_q_text"))
    out = out.drop("_q_text", "_q_markov", *[f"_q_{k}" for k in BASE])
    out = _running(out, "_q_past", F.transform("_q_all", lambda x: F.when(x["rank"] < len(BASE), x["end"]).otherwise(0)), F.greatest)
    # places of starts from the end of the text, so that a running maximum from the end is the next base start
    starts = F.transform("_q_all", lambda x: F.when(x["rank"] < len(BASE), F.col("_q_size") - x["start"]).otherwise(0))
    out = _running(out, "_q_next", F.reverse(starts), F.greatest)
    out = out.withColumn("_q_zip", F.arrays_zip("_q_all", "_q_past", F.reverse("_q_next").alias("_q_next")))

    def stays(x: Column) -> Column:
        own = x["_q_all"]
        clear = (x["_q_past"] <= own["start"]) & (F.col("_q_size") - x["_q_next"] >= own["end"])
        return F.when(own["rank"] < len(BASE), True).when(~clear, False).otherwise(random(own))

    def bare(x: Column) -> Column:
        return F.struct(*[x["_q_all"][c].alias(c) for c in ("start", "rank", "kind", "end")])

    kept = F.transform(F.filter("_q_zip", stays), bare)
    return out.withColumn("secrets", kept).drop("_q_all", "_q_past", "_q_next", "_q_size", "_q_zip")


def _score(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token of ALPHABET's characters, one pass over them."""
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("total"))

    def step(a: Column, p: Column) -> Column:
        more = F.when((a["last"] > 0) & (p > 0), F.element_at(weights, (a["last"] - 1) * len(ALPHABET) + p)).otherwise(0.0)
        return F.struct(p.alias("last"), (a["total"] + more).alias("total"))

    return F.aggregate(places, start, step, lambda a: a["total"])


#: Code points of a text that are cut from it at once.
_CUT = 4096


def redact(found: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replace every span of ``secrets`` in the text by ``mask``, overlapping spans by one, and drop ``secrets``.

    Texts without a secret, null ones among them, stay as they are. The text is cut into stretches of _CUT code points, from
    which the gaps between spans are read, so a text of many spans costs its length.
    """
    t = F.col(text)
    cuts = F.when(F.size("secrets") > 0, F.regexp_extract_all(t, F.lit(r"[\s\S]{1,%d}" % _CUT), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = _running(found.withColumn("_q_cuts", cuts), "_q_upto", F.transform("secrets", lambda s: s["end"]), F.greatest)

    def between(start: Column, end: Column) -> Column:
        first, last = F.floor(start / _CUT).cast("int"), F.floor(end / _CUT).cast("int")
        head, tail = F.get("_q_cuts", first), F.coalesce(F.get("_q_cuts", last), F.lit(""))
        one = F.substr(head, start % _CUT + 1, end - start)
        more = F.concat(F.substr(head, start % _CUT + 1, F.lit(_CUT)), F.array_join(F.slice("_q_cuts", first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substr(tail, F.lit(1), end % _CUT))
        return F.when(first == last, F.coalesce(one, F.lit(""))).otherwise(more)

    def gap(s: Column, i: Column) -> Column:
        past = F.when(i > 0, F.get("_q_upto", i - 1)).otherwise(0)
        return F.when(s["start"] >= past, F.concat(between(past, s["start"]), F.lit(mask))).otherwise("")

    rest = between(F.element_at("_q_upto", -1), F.length(t))
    whole = F.concat(F.array_join(F.transform("secrets", gap), ""), rest)
    return out.withColumn(text, F.when(F.size("secrets") > 0, whole).otherwise(t)).drop("secrets", "_q_cuts", "_q_upto")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op3_secrets(docs: DataFrame) -> DataFrame:
    """The contract's columns for all ``documents``."""
    rows = find_secrets(docs.select("doc_id", "text"), fit_model(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda x: x["kind"] != "markov")
    return rows.select(
        "doc_id", *map(count, [*BASE, "markov"]), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans")
    )
