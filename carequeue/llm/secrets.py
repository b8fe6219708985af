"""Secret scans: fixed patterns, and character Markov models of random strings against identifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.llm.shared import checkpointed, table


@dataclass(frozen=True)
class Kind:
    """A pattern; the least length of its group, else the match is dropped."""

    name: str
    pattern: str
    group: int
    least: int


#: Kinds in the order in which spans of one start are listed. The last two need their least length to
#: match at all, which finds the same as longest runs of which shorter ones are dropped.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)
MARKOV = "markov"
#: Strings that the models judge, and identifiers that they learn from.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{8,}"
#: A candidate is a secret if its log-likelihood ratio exceeds this many nats, and this many per pair of characters.
LEAST_RATIO = 16.0
LEAST_PER_PAIR = 0.7
#: Rules of dashes and the like are improbable as identifiers but not random: a secret has this many symbols.
LEAST_SYMBOLS = 8
#: Weight of the prior of each model's rows, in pairs.
PRIOR = 66.0
#: Spans that are put together one by one.
BLOCK = 256
CODES = 128
SYMBOLS = 66


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    """The items in arrays of BLOCK: what grows by one item at a time is copied within a block alone."""
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, stop, value>> of the leftmost matches that don't overlap, in code points.

    The parts between the matches and the matches, put together in turn, are the text: so places are sums of lengths.
    """
    parts = F.struct(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")

    def add(done: Column, row: Column) -> Column:
        start = done["at"] + row["gap"]
        stop = start + row["size"]
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), row["value"].alias("value")))
        return F.struct(stop.alias("at"), F.concat(done["spans"], one).alias("spans"))

    def moved(by: Column, spans: Column) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct((by + x["start"]).alias("start"), (by + x["stop"]).alias("stop"), x["value"].alias("value")),
        )

    def follow(done: Column, block: Column) -> Column:
        spans = F.concat(done["blocks"], F.array(moved(done["at"], block["spans"])))
        return F.struct((done["at"] + block["at"]).alias("at"), spans.alias("blocks"))

    def spans(found: Column) -> Column:
        rows = F.arrays_zip(
            F.transform(found["between"], F.length).alias("gap"),
            F.transform(found["whole"], F.length).alias("size"),
            found["value"].alias("value"),
        )
        # The last part has no match after it. Blocks count from their own start, then follow one another.
        matched = F.slice(rows, 1, F.size(found["whole"]))
        blocks = F.transform(_blocks(matched), lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("spans")), add))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,stop:int,value:string>>>").alias("blocks"))
        return F.aggregate(blocks, start, follow, lambda done: F.flatten(done["blocks"]))

    empty = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(parts, spans)).otherwise(empty)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, stop, value>> of the fixed patterns; kind is the place in KINDS."""
    found = []
    for number, kind in enumerate(KINDS):
        found.append(_kept(_matches(text, kind.pattern, kind.group), number, kind.least))
    return F.array_sort(F.concat(*found))


def _kept(spans: Column, number: int, least: int) -> Column:
    enough = F.filter(spans, lambda x: F.length(x["value"]) >= least)
    return F.transform(
        enough,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(number).alias("kind"), x["stop"].alias("stop"), x["value"].alias("value")
        ),
    )


def _pairs(value: Column) -> Column:
    """Codes of all two neighbouring characters of an ASCII string."""
    return _let(
        F.transform(F.split(value, ""), F.ascii),
        lambda codes: F.transform(
            F.sequence(F.lit(0), F.length(value) - 2), lambda i: F.get(codes, i) * CODES + F.get(codes, i + 1)
        ),
    )


def _pair_counts(values: DataFrame) -> DataFrame:
    """(pair, n) over all strings `value`."""
    pairs = values.where("length(value) >= 2").select(F.explode(_pairs(F.col("value"))).alias("pair"))
    return pairs.where(f"pair >= 0 and pair < {CODES * CODES}").groupBy("pair").agg(F.count("*").alias("n"))


def labelled_samples(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Secrets and identifiers, as distinct strings `value`: what the fixed patterns find, and words, of all documents."""
    text = F.coalesce("text", F.lit(""))
    secrets = docs.select(F.explode(F.transform(base_spans(text), lambda x: x["value"])).alias("value"))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))).alias("value"))
    # A word that a fixed pattern finds is no identifier.
    return secrets.distinct(), words.distinct().where(~F.regexp_like("value", F.lit("|".join(f"({kind.pattern})" for kind in reversed(KINDS)))))


def train(secrets: DataFrame, identifiers: DataFrame, prior: float = PRIOR) -> DataFrame:
    """One row: `ratios`, log P(next | this) of random strings less that of identifiers, by pair of characters.

    Of two first-order Markov models over the 66 symbols of a candidate. The random one's prior has the same chance for
    each symbol, so kinds of secrets that no sample shows still look random; the identifiers' prior is how often
    a symbol occurs in them, so symbols they seldom have stay improbable after any other. One of each pair's
    occurrences in identifiers does not count: the sample may hold the very string that is judged.
    """
    both = (
        _pair_counts(secrets)
        .withColumnRenamed("n", "random")
        .join(_pair_counts(identifiers).withColumnRenamed("n", "ordinary"), "pair", "full")
    )
    codes = secrets.sparkSession.range(CODES * CODES).select(F.col("id").cast("int").alias("pair"))
    dense = codes.join(both, "pair", "left").select(
        "pair",
        F.floor(F.col("pair") / CODES).alias("this"),
        (F.col("pair") % CODES).alias("next"),
        F.coalesce("random", F.lit(0)).alias("random"),
        F.greatest(F.col("ordinary") - 1, F.lit(0)).alias("ordinary"),
    )
    # At most CODES * CODES rows, whatever the input.
    dense = checkpointed(dense)
    total = dense.agg(F.sum("ordinary")).scalar()
    after = dense.groupBy("this").agg(F.sum("random").alias("randoms"), F.sum("ordinary").alias("ordinaries"))
    often = dense.groupBy("next").agg(((F.sum("ordinary") + 1) / (total + SYMBOLS)).alias("often"))
    random = (F.col("random") + prior / SYMBOLS) / (F.col("randoms") + prior)
    ordinary = (F.col("ordinary") + prior * F.col("often")) / (F.col("ordinaries") + prior)
    rows = dense.join(after, "this").join(often, "next").select("pair", (F.log(random) - F.log(ordinary)).alias("ratio"))
    ordered = F.array_sort(F.collect_list(F.struct("pair", "ratio")))
    return rows.agg(F.transform(ordered, lambda x: x["ratio"]).alias("ratios"))


def _markov_spans(text: Column, ratios: Column, base: Column, least: float, per_pair: float) -> Column:
    """Candidates that the models take for random and that no base span touches."""

    def random(x: Column) -> Column:
        pairs = F.length(x["value"]) - 1
        ratio = F.aggregate(_pairs(x["value"]), F.lit(0.0), lambda done, pair: done + F.get(ratios, pair))
        enough = F.size(F.array_distinct(F.split(x["value"], ""))) >= LEAST_SYMBOLS
        return enough & _let(ratio, lambda r: (r > least) & (r > pairs * per_pair))

    def touch(b: Column, x: Column) -> Column:
        return (b["start"] < x["stop"]) & (x["start"] < b["stop"])

    def bounded(block: Column) -> Column:
        stops = F.array_max(F.transform(block, lambda b: b["stop"]))
        return F.struct(F.get(block, F.lit(0))["start"].alias("start"), stops.alias("stop"), block.alias("spans"))

    def apart(blocks: Column) -> Column:
        def untouched(x: Column) -> Column:
            return ~F.exists(blocks, lambda block: touch(block, x) & F.exists(block["spans"], lambda b: touch(b, x)))

        return F.filter(F.filter(_matches(text, CANDIDATE, 0), random), untouched)

    # Base spans are in order of their start, so that of a block's first is the least.
    found = _let(F.transform(_blocks(base), bounded), apart)
    return F.transform(
        found,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["stop"].alias("stop"), x["value"].alias("value")
        ),
    )


def find_secrets(docs: DataFrame, least: float = LEAST_RATIO, per_pair: float = LEAST_PER_PAIR) -> DataFrame:
    """Docs with the columns `base` and `spans`: arrays of (start, kind, stop, value) in code points, stop exclusive.

    base holds the fixed patterns' spans in order of start and kind, spans these and those of the Markov models, whose
    kind is the number after the last of KINDS. The models are trained here, from the documents' own labelled samples:
    what the fixed patterns find, and words. Null and empty texts have no spans; without any samples
    the models find nothing. Repeated rows and rows without id are scanned like others. Columns of docs called
    base or spans are replaced.
    """
    ratios = checkpointed(train(*labelled_samples(docs.select("doc_id", "text"))))
    columns = [c for c in docs.columns if c.lower() not in ("base", "spans")]
    text = F.coalesce(docs["text"], F.lit(""))
    scanned = docs.select(*(docs[c] for c in columns), F.explode(F.array(base_spans(text))).alias("base"))
    with_ratios = scanned.withColumn("_ratios", ratios.scalar())
    markov = _markov_spans(F.coalesce("text", F.lit("")), F.col("_ratios"), F.col("base"), least, per_pair)
    spans = F.array_sort(F.concat("base", markov))
    return with_ratios.select(*columns, "base", spans.alias("spans"))


def _listed(spans: str) -> Column:
    names = F.array(*(F.lit(kind.name) for kind in KINDS), F.lit(MARKOV))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def _number(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")


def redact(docs: DataFrame, mask: str = "<secret>") -> DataFrame:
    """Docs with each secret in `text` replaced by the mask, overlapping ones by one, and n_chars, if there, renewed."""
    found = find_secrets(docs)

    def place(done: Column, block: Column) -> Column:
        stop = F.greatest(done["at"], F.array_max(F.transform(block, lambda x: x["stop"])))
        placed = F.struct(done["at"].alias("start"), stop.alias("stop"), block.alias("spans"))
        return F.struct(stop.alias("at"), F.concat(done["blocks"], F.array(placed)).alias("blocks"))

    def pieces(block: Column) -> Column:
        def of(own: Column) -> Column:
            def add(done: Column, x: Column) -> Column:
                between = F.substring(own, done["at"] - block["start"] + 1, x["start"] - done["at"])
                more = F.when(x["start"] >= done["at"], F.array(between, F.lit(mask))).otherwise(none)
                return F.struct(F.greatest(done["at"], x["stop"]).alias("at"), F.concat(done["pieces"], more).alias("pieces"))

            start = F.struct(block["start"].alias("at"), none.alias("pieces"))
            return F.aggregate(block["spans"], start, add, lambda done: done["pieces"])

        return _let(F.substring(F.col("text"), block["start"] + 1, block["stop"] - block["start"]), of)

    def joined(placed: Column) -> Column:
        rest = F.substring(F.col("text"), placed["at"] + 1, F.length("text"))
        return F.concat(F.array_join(F.flatten(F.transform(placed["blocks"], pieces)), ""), rest)

    # A block of spans begins where all before have ended, and is cut out of the text before its own spans are.
    none = F.array().cast("array<string>")
    kind = "array<struct<start:int,stop:int,spans:array<struct<start:int,kind:int,stop:int,value:string>>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("blocks"))
    masked = _let(F.aggregate(_blocks(F.col("spans")), start, place), joined)
    text = F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))
    renewed = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = F.when(F.size("spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
        renewed = renewed.withColumn("n_chars", changed)
    return renewed.select(docs.columns)


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of all documents."""
    found = find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(_number(k).alias(f"n_{kind.name}") for k, kind in enumerate(KINDS)),
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
    )
