"""Personal data: base patterns, and bootstrapped extraction from contexts that seeds share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm import spans
from watchloom.llm.common import Workspace, sized

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that one pass over a text decides every start: a run that fails is
#: not tried again from its middle (\G lets a match follow the last one directly), and where a group
#: would repeat, the end is found by looking ahead instead, so long runs need no recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])[A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|(?![A-Za-z0-9.-]))"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?=[\x20-](?![0-9])|(?![0-9\x20-]))"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: Loose shapes of identifiers: what contexts may discover. Runs of digits and their separators, and
#: addresses whose at sign or dots are spelled out or unusual.
LOOSE = r"(?<![0-9().+-])[+(]?[0-9][0-9\x20().+/-]{5,}[0-9]|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9.-]+"
#: Code points of context on either side of an instance. A word that goes on beyond them is LONG,
#: whatever it is, so a pattern never depends on where a word was cut.
REACH, LONG = 24, "~"
#: Rounds of scoring; support and confidence that a pattern needs; support of patterns and
#: confidence that an instance needs to be taken.
ROUNDS, LEAST_SEEDS, LEAST_PATTERN, LEAST_PATTERNS, LEAST_INSTANCE = 3, 3, 0.6, 2, 0.7


def base_spans(text: Column) -> dict[str, Column]:
    size = lambda s: F.length(spans.digits(s["value"]))
    return {
        "email": spans.find(text, EMAIL),
        "ip": F.filter(spans.find(text, IP), lambda s: s["value"].rlike(IP_PARTS)),
        "card": F.filter(spans.find(text, CARD), lambda s: size(s).between(14, 19) & F.call_function("luhn_check", spans.digits(s["value"]))),
        "phone": F.filter(spans.find(text, PHONE), lambda s: size(s).between(10, 15)),
    }


def shape(value: Column) -> Column:
    """Digits as 9, letters as a; the lengths of digit runs stay."""
    return F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Za-z]+", "a")


def word_before(left: Column) -> Column:
    """The last word of the left context, lower-cased with digits as 9; ^ at a line's start."""
    word = F.nullif(F.regexp_extract(F.regexp_replace(F.lower(left), "[0-9]", "9"), r"(\S+)[\x20\t]*$", 1), F.lit(""))
    return F.when((F.length(left) >= REACH) & left.rlike(r"^\S+[\x20\t]*$"), F.lit(LONG)).otherwise(F.coalesce(word, F.lit("^")))


def word_after(right: Column) -> Column:
    word = F.nullif(F.regexp_extract(F.regexp_replace(F.lower(right), "[0-9]", "9"), r"^[\x20\t]*(\S+)", 1), F.lit(""))
    return F.when((F.length(right) >= REACH) & right.rlike(r"^[\x20\t]*\S+$"), F.lit(LONG)).otherwise(F.coalesce(word, F.lit("$")))


def contexts(text: Column, found: Column) -> Column:
    """The patterns an instance occurs in: the words around it, with its shape, and both."""

    def of(s: Column) -> Column:
        left = word_before(F.substring(text, F.greatest(s["start"] - REACH, F.lit(0)) + 1, F.least(s["start"], F.lit(REACH))))
        right = word_after(F.substring(text, s["end"] + 1, F.lit(REACH)))
        form = shape(s["value"])
        patterns = F.array(F.concat(F.lit("l:"), left, F.lit(" "), form), F.concat(F.lit("r:"), form, F.lit(" "), right), F.concat(F.lit("b:"), left, F.lit(" _ "), right), F.concat(F.lit("s:"), form), F.concat(F.lit("L:"), left), F.concat(F.lit("R:"), right))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lower(s["value"]).alias("instance"), patterns.alias("patterns"))

    return F.transform(found, of)


def bootstrap(ws: Workspace, instances: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """instance, kind, confidence of instances that contexts discover.

    ``instances`` has instance, seed (its kind, null if it is to be discovered) and patterns. The
    bipartite graph of patterns and instances is scored in rounds: a pattern's confidence in a kind
    is the summed score of that kind among its instances over their number, its support that sum; an
    instance's score is the mean confidence of its patterns that have support LEAST_SEEDS and
    confidence LEAST_PATTERN. Seeds keep score 1; what is discovered counts with its score in the next
    round and can give other patterns support, so patterns spread from known identifiers to unseen
    ones step by step. However often an instance occurs in a pattern, it is one edge, so copies weigh
    nothing. Of kinds that tie for an instance the last by name is taken. Edges are made distinct
    before any join, and every join is on a pattern or an instance, which AQE splits when hot.
    """
    edges = ws.store(instances.select("instance", "seed", F.explode("patterns").alias("pattern")).distinct())
    seeds = edges.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    total = ws.store(edges.groupBy("pattern").agg(F.count("*").alias("all")))
    size = total.count()
    scored = seeds
    for _ in range(rounds):
        own = edges.join(scored, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("support")).where(F.col("support") >= LEAST_SEEDS)
        patterns = own.join(total, "pattern").select("pattern", "kind", (F.col("support") / F.col("all")).alias("confidence")).where(F.col("confidence") >= LEAST_PATTERN)
        patterns = ws.store(patterns, rows=size)
        unseen = edges.where("seed is null").join(patterns, "pattern").groupBy("instance", "kind").agg(F.avg("confidence").alias("score"), F.countDistinct("pattern").alias("patterns"))
        best = unseen.where((F.col("patterns") >= LEAST_PATTERNS) & (F.col("score") >= LEAST_INSTANCE)).groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b"))
        found = ws.store(best.select("instance", F.col("b.kind").alias("kind"), F.col("b.score").alias("score")), rows=size)
        scored = seeds.unionByName(found)
    return found.withColumnRenamed("score", "confidence")


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_found for every row of documents.

    The base spans are the seeds; loose candidates (LOOSE) that overlap none are taken, with the
    kind of the patterns that found them, as ``bootstrap`` decides over all documents. Counts and
    digest are of base spans. Texts are read whole, however long; spans that start together come in
    the order of KINDS. Null and empty texts have no spans; repeated rows equal results; other
    columns are ignored; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = rows.select("doc_id", "text", spans.labelled(base_spans(F.col("text"))).alias("base"), spans.find(F.col("text"), LOOSE).alias("loose"))
    loose = F.transform(spans.outside(F.col("loose"), F.col("base")), lambda s: F.struct(s["start"].alias("start"), F.lit(-1).alias("rank"), s["end"].alias("end"), F.lit(None).cast("string").alias("kind"), s["value"].alias("value")))
    found = marked.select("doc_id", "base", contexts(F.col("text"), F.concat("base", loose)).alias("seen"))
    found = ws.store(found.withColumn("row", F.monotonically_increasing_id()))
    instances = found.select(F.explode("seen").alias("s")).select(F.col("s.instance"), F.col("s.kind").alias("seed"), F.col("s.patterns"))
    known = bootstrap(ws, instances, rounds)
    open_ = found.select("row", F.explode("seen").alias("s")).where("s.kind is null").select("row", "s.start", "s.end", "s.instance")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    span = F.struct("start", rank.alias("rank"), "end", "kind", F.col("instance").alias("value"))
    added = open_.join(sized(known), "instance").groupBy("row").agg(F.collect_list(span).alias("added"))
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(found.schema["base"].dataType))))
    out = found.join(added, "row", "left").select("doc_id", "base", every.alias("every"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_found"))
    return out.select("doc_id", *(spans.count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS), spans.digest(F.col("base")).alias("base_sha256"), spans.joined(F.col("every")).alias("spans"), "n_found")
