"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become sequences of lower-case words in which numbers (in digits or words), units after numbers, and names
(runs of capitalised words wherever they stand, so that a word's placeholder does not hang on what precedes
it) are typed placeholders; punctuation and case go. Every window of
WINDOW words of a document is looked up among the windows of the benchmark by hash (an item shorter than that,
but of SHORTEST words, is one window of its own length). A document that holds an item's windows
at one alignment also yields pairs of slot values there: the benchmark's and the document's. If the pairs are a
one-to-one substitution (the identity for a verbatim copy), the windows count; else only windows without
slots do. A document is contaminated by an item if MIN_SHARE of the item's windows count.
Items are looked up verbatim as well, by windows of words with numbers and names in place, which
need no literal words; MIN_SHARE of these will do.

Defined cases: null and empty texts hold nothing and are kept; items below SHORTEST words, and
windows mostly made of placeholders, match verbatim only; items below SHORTEST_VERBATIM words match nothing;
n_windows, share and n_slots are those of the template windows where these suffice, else of the verbatim
ones with n_slots 0; a text of any length is looked up by all of its windows; items that share windows are each judged by all of their own windows and
slots, so a document may be reported with several; a window that an item holds twice counts once; repeated
documents are decided alike, each row kept or dropped; an empty benchmark drops nothing, an empty table gives no
rows; columns of the documents are returned as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.storage import BROADCAST_IDS, materialise

WINDOW, SHORTEST, MIN_SHARE = 8, 5, 0.25
#: Words of a window that must not be placeholders, unless it is looked up verbatim.
MIN_LITERAL = 5
#: Words of the shortest item looked up verbatim; fewer words stand in too many clean texts.
SHORTEST_VERBATIM = 3
#: Benchmark windows (24 bytes each) that are broadcast; beyond it they are shuffled.
SHIPPED_WINDOWS = 1_000_000
UNITS = "%|percent|km|kg|cm|mm|mg|ml|m|g|l|h|s|mph|kwh|kb|mb|gb|inch|inches|foot|feet|mile|miles|meter|meters|metre|metres|gram|grams|liter|liters|litre|litres|second|seconds|minute|minutes|hour|hours|day|days|week|weeks|month|months|year|years|dollar|dollars|cent|cents|euro|euros|pound|pounds|degree|degrees"
NUMBER, NAME, UNIT = "0", "2", "1"
GAP = r"[^\p{L}\p{N}]+"
NUMBER_RE = r"[$€£]?\p{N}(?:[\p{N}.,:/]*\p{N})?"
_SMALL = "one|two|three|four|five|six|seven|eight|nine"
_COUNT = r"(?:[zZ]ero|[oO]ne|[tT](?:wo|hree|en|welve|hirteen|hirty|wenty|housand)|[fF](?:our(?:teen)?|orty|ive|ifteen|ifty)|[sS](?:ix(?:teen|ty)?|even(?:teen|ty)?)|[eE](?:ight(?:een|y)?|leven)|[nN]ine(?:teen|ty)?|[hH]undred|[mM]illion|[bB]illion|[dD]ozen)"
#: Numbers in digits or words; a name is a capitalised word with a small letter, also O'Neil, McKay and Smith-Jones, or up to four such
#: (repetitions of groups are bounded, as the matcher recurses in them).
COUNT_RE = rf"{NUMBER_RE}|\b{_COUNT}(?:(?<=ty)[- ](?:{_SMALL}))?\b"
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{L}*\p{Ll}\p{L}*(?:-\p{Lu}\p{L}+){0,2}"
NAME_RE = rf"(?<![\p{{L}}\p{{N}}]){_NAME}(?: {_NAME}){{0,3}}"
UNIT_RE = rf"(?<= {NUMBER} ) ?(?:{UNITS})(?![\p{{L}}\p{{N}}])"


def bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once, also where ``then`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _named(text: Column) -> Column:
    """Placeholders for numbers, then units, then names; other digits are gone by then."""
    text = F.regexp_replace(text, COUNT_RE, f" {NUMBER} ")
    return F.regexp_replace(text, NAME_RE, f" {NAME} ")


def template(text: Column) -> Column:
    """Array of canonical words."""
    marked = F.regexp_replace(F.lower(_named(text)), UNIT_RE, f" {UNIT} ")
    return F.array_remove(F.split(marked, GAP), "")


def verbatim(text: Column) -> Column:
    """Array of lower-case words and numbers, as they stand but for punctuation."""
    return F.array_remove(F.split(F.lower(text), GAP), "")


def slots(text: Column, words: Column) -> Column:
    """Array of (at, value) of a text's placeholders, from the text and its template."""
    numbers = F.regexp_extract_all(text, F.lit(f"({COUNT_RE})"), 1)
    numbered = F.regexp_replace(text, COUNT_RE, f" {NUMBER} ")
    names = F.regexp_extract_all(numbered, F.lit(f"({NAME_RE})"), 1)
    units = F.regexp_extract_all(F.lower(_named(text)), F.lit(f"({UNIT_RE})"), 1)

    def of(kind: str, values: Column, words: Column) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.when(w == kind, i)), lambda i: i.isNotNull())
        return F.transform(F.arrays_zip(at.alias("at"), values.alias("value")), lambda x: F.struct(x["at"].alias("at"), F.concat(F.lit(kind + ":"), F.lower(F.trim(x["value"]))).alias("value")))

    return bound(words, lambda w: F.concat(of(NUMBER, numbers, w), of(UNIT, units, w), of(NAME, names, w)))


def windows(words: Column, length: int) -> Column:
    """Hash of every window of ``length`` words: hashes of 1, 2, 4 ... words are made of two of half the length, and the
    window's of those that make up its length."""
    none = F.array().cast("array<bigint>")

    def longer(spans: dict[int, Column]) -> Column:
        top = max(spans)
        if 2 * top <= length:
            return bound(F.transform(spans[top], lambda h, i: F.xxhash64(h, F.get(spans[top], i + top))), lambda twice: longer({**spans, 2 * top: twice}))
        parts, at = [], 0
        for k in sorted(spans, reverse=True):
            if at + k <= length:
                parts.append((spans[k], at))
                at += k
        first = F.slice(spans[top], 1, F.size(spans[1]) - length + 1)
        return first if len(parts) == 1 else F.transform(first, lambda h, i: F.xxhash64(h, *[F.get(a, i + o) for a, o in parts[1:]]))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= length, longer({1: h})).otherwise(none))


def _identified(docs: DataFrame, id_: str = "__id", text: str = "__text") -> DataFrame:
    """A row's identity is its id and the hash of its text; rows alike in both are decided alike."""
    return docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn(text, F.xxhash64("text"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """(__id, __text, doc_id, item_id, n_windows, share, n_slots) of contaminated documents, and the items."""
    items = benchmark.select("item_id", "text").dropna().withColumn("words", template(F.col("text"))).withColumn("exact", verbatim(F.col("text")))
    # Lengths of an item's windows; 0 where it has none of the kind.
    sized = lambda words, least: F.when(F.size(words) >= least, F.least(F.size(words), F.lit(window))).otherwise(0)
    items = materialise(items.withColumn("length", sized("words", SHORTEST)).withColumn("exact_length", sized("exact", SHORTEST_VERBATIM)), "items")
    lengths, exact_lengths = ([r[0] for r in items.where(F.col(c) > 0).select(c).distinct().orderBy(c).collect()] for c in ("length", "exact_length"))
    need = lambda k: min(MIN_LITERAL, k - 1)
    bench = None
    for k in lengths:
        of = items.where(F.col("length") == k).select("item_id", "words", F.posexplode(windows(F.col("words"), k)).alias("item_at", "hash"))
        literal = F.size(F.filter(F.slice("words", F.col("item_at") + 1, k), lambda w: ~w.isin(NUMBER, NAME, UNIT)))
        of = of.where(literal >= need(k)).select("hash", "item_id", "item_at", F.lit(k).alias("length"), F.lit(False).alias("exact"))
        bench = of if bench is None else bench.union(of)
    for k in exact_lengths:
        of = items.where(F.col("exact_length") == k).select("item_id", F.posexplode(windows(F.col("exact"), k)).alias("item_at", "hash"))
        of = of.select("hash", "item_id", "item_at", F.lit(k).alias("length"), F.lit(True).alias("exact"))
        bench = of if bench is None else bench.union(of)
    found_schema = "__id long, __text long, at int, hash long, item_id long, item_at int, length int, exact boolean"
    if bench is None:
        found = docs.sparkSession.createDataFrame([], found_schema)
    else:
        bench = materialise(bench.distinct(), "bench")
        side = F.broadcast(bench) if bench.limit(SHIPPED_WINDOWS + 1).count() <= SHIPPED_WINDOWS else bench
        texts = _identified(docs.select("doc_id", "text")).where("text is not null").select("__id", "__text", template(F.col("text")).alias("words"), verbatim(F.col("text")).alias("exact"))
        kinds = [(k, c == "exact", F.col(c)) for c, of in (("words", lengths), ("exact", exact_lengths)) for k in of]
        looked = texts.select("__id", "__text", F.explode(F.array(*[F.struct(F.lit(k).alias("length"), F.lit(e).alias("exact"), windows(c, k).alias("w")) for k, e, c in kinds])).alias("x"))
        met = looked.select("__id", "__text", F.col("x.length").alias("length"), F.col("x.exact").alias("exact"), F.posexplode("x.w").alias("at", "hash")).join(side, ["hash", "length", "exact"])
        found = met.select("__id", "__text", "at", "hash", F.col("item_id").cast("long").alias("item_id"), "item_at", "length", "exact").distinct()
    met_all = materialise(found, "windows_found").withColumn("shift", F.col("at") - F.col("item_at"))
    pair = ["__id", "__text", "item_id", "shift"]
    found, copied = met_all.where(~F.col("exact")), met_all.where("exact")
    # Slot values of the documents found, and of the items, at the matched windows.
    ids = found.select("__id", "__text").distinct()
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    held = _identified(docs.select("doc_id", "text")).join(F.broadcast(ids) if small else ids, ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"]).withColumn("words", template(F.col("text")))
    doc_slots = held.select("__id", "__text", F.explode(slots(F.col("text"), F.col("words"))).alias("s")).select("__id", "__text", F.col("s.at").alias("slot"), F.col("s.value").alias("doc_value"))
    item_slots = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(slots(F.col("text"), F.col("words"))).alias("s")).select("item_id", F.col("s.at").alias("item_slot"), F.col("s.value").alias("item_value")).dropDuplicates(["item_id", "item_slot"])
    covered = found.select(*pair, F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("slot")).distinct()
    pairs = covered.join(doc_slots, ["__id", "__text", "slot"]).withColumn("item_slot", (F.col("slot") - F.col("shift")).cast("int")).join(item_slots, ["item_id", "item_slot"])
    pairs = pairs.select(*pair, "item_value", "doc_value", "slot")
    forth = pairs.groupBy(*pair, "item_value").agg((F.min("doc_value") != F.max("doc_value")).alias("broken"))
    back = pairs.groupBy(*pair, "doc_value").agg((F.min("item_value") != F.max("item_value")).alias("broken"))
    broken = forth.where("broken").select(*pair).union(back.where("broken").select(*pair)).distinct().withColumn("broken", F.lit(True))
    slotted = pairs.select(*pair, "slot").distinct()
    with_slots = found.join(slotted, pair).where("slot between at and at + length - 1").groupBy(*pair, "at", "length").agg(F.count("*").alias("slots"))
    judged = found.join(with_slots, [*pair, "at", "length"], "left").join(broken, pair, "left").where("broken is null or slots is null")
    counted = judged.groupBy("__id", "__text", "item_id").agg(F.countDistinct("hash", "length").alias("n_windows"), F.coalesce(F.sum("slots"), F.lit(0)).alias("n_slots"))
    exact = copied.groupBy("__id", "__text", "item_id").agg(F.countDistinct("hash", "length").alias("n_windows"), F.lit(0).cast("long").alias("n_slots"))
    counted = counted.withColumn("exact", F.lit(False)).unionByName(exact.withColumn("exact", F.lit(True)))
    sizes = bench.groupBy("item_id", "exact").agg(F.countDistinct("hash", "length").alias("of")) if bench is not None else docs.sparkSession.createDataFrame([], "item_id long, exact boolean, of long")
    shared = counted.join(sizes, ["item_id", "exact"]).withColumn("share", F.col("n_windows") / F.col("of")).where(F.col("share") >= min_share)
    out = shared.groupBy("__id", "__text", "item_id").agg(F.min_by(F.struct("n_windows", "share", "n_slots"), "exact").alias("x")).select("__id", "__text", "item_id", "x.*")
    return out.select("__id", "__text", F.when(F.col("__id") != -(2**63), F.col("__id")).alias("doc_id"), "item_id", "n_windows", "share", "n_slots")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` without the contaminated rows."""
    found = materialise(find_contamination(docs, benchmark, window, min_share).select("__id", "__text").distinct(), "contaminated")
    small = found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = [x + "_" * max(map(len, docs.columns)) for x in ("__id", "__text")]  # longer than any name there is
    found = found.toDF(*own)
    return _identified(docs, *own).join(F.broadcast(found) if small else found, own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, with the items."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_windows", F.round("share", 4).alias("share"), "n_slots").distinct()
