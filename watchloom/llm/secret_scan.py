"""Secret scans: base patterns, and character Markov models of random strings and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm import spans
from watchloom.llm.common import Workspace

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run that is too short for one AKIA is so for all later ones
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Characters that the models tell apart; any other counts as one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SYMBOLS = len(ALPHABET) + 1
TOKEN = "[A-Za-z0-9+/_=-]"
#: Shortest token that is judged: fewer characters hardly reach LEAST_TOTAL.
JUDGED = 12
#: Labelled samples of each class, made by rule: digests, and identifiers put together from WORDS.
SAMPLES = 20_000
#: Words of identifiers and of plain text in several languages.
WORDS = """account action address archive array backup batch buffer button cache channel client cluster code column
config connection content context control counter customer data date default device document domain download driver
element error event export factory field file filter folder format function graph group handler header height
history identifier image import index input instance interface internal item key language length level library line
list loader location manager measure member message method model module name network node notification number object
option order output package page parameter parser password path pattern payment platform pointer policy position
process product profile project property protocol provider query queue reader record reference region register
release report request resource response result return route schedule schema script search section sender sequence
server service session setting shipping source state status storage stream string summary support system table
target template test thread timeout timer token total transaction transport type update upload user value variable
vector version view widget window worker writer
schlich keit heit ung ver einstellung verbindung benutzer geschwindigkeit nachricht zwischen entwicklung schreiben
ment tion elle aux eau quement configuration utilisateur connaissance chercher fichier toujours enregistrement
mente dad cion ando ella aquello usuario configurar respuesta archivo siempre trabajo desarrollo""".split()
#: Share of a transition's probability that depends on its second character alone.
BACKOFF = 0.1
#: Log-likelihood ratio that a token needs in all and per character pair.
LEAST_TOTAL, LEAST_MEAN = 8.0, 0.5


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base patterns; offsets are of whole matches."""
    return {"assign": F.filter(spans.find(text, ASSIGN, 2), lambda s: F.length(s["extra"]) >= 6), "access": spans.find(text, ACCESS), "hex": spans.find(text, HEX)}


def code_of(c: Column) -> Column:
    """Number of a character in the alphabet; any other has the next."""
    at = F.instr(F.lit(ALPHABET), c)
    return F.when((at > 0) & (c != ""), at - 1).otherwise(len(ALPHABET))


def pair_codes(token: Column) -> Column:
    """Codes of the pairs of adjacent characters of a token."""
    code = F.transform(F.split(token, ""), code_of)
    size = F.size(code)
    return F.when(size < 2, F.array().cast("array<int>")).otherwise(F.zip_with(F.slice(code, 1, F.greatest(size - 1, F.lit(0))), F.slice(code, 2, F.greatest(size - 1, F.lit(0))), lambda a, b: (a * SYMBOLS + b).cast("int")))


def pair_counts(tokens: DataFrame) -> DataFrame:
    """pair, n over (token, n): pairs are counted as text, and only distinct ones get codes."""
    at = tokens.where(F.length("token") > 1).select("n", "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    pairs = at.select("n", F.substring("token", F.col("i"), F.lit(2)).alias("p")).groupBy("p").agg(F.sum("n").alias("n"))
    code = code_of(F.substring("p", 1, 1)) * SYMBOLS + code_of(F.substring("p", 2, 1))
    return pairs.groupBy(code.cast("int").alias("pair")).agg(F.sum("n").alias("n"))


def random_samples(spark) -> DataFrame:
    """Samples labelled random: digests of the first SAMPLES numbers as hexadecimal digits, base 64 and
    letters with digits, of several lengths."""
    number = F.col("id").cast("string").cast("binary")
    base64 = F.regexp_replace(F.base64(F.unhex(F.sha2(number, 256))), "=", "")
    cut = lambda c: F.substring(c, 1, (F.pmod(F.xxhash64("id"), F.lit(33)) + 8).cast("int"))
    plain = F.regexp_replace(base64, "[+/]", "")
    both = F.array(cut(F.sha2(number, 256)), cut(base64), cut(plain), cut(F.lower(plain)), cut(F.upper(plain)))
    return spark.range(SAMPLES).select(F.explode(both).alias("token"), F.lit(1).alias("n"))


def ordinary_samples(spark) -> DataFrame:
    """Samples labelled ordinary: two to four of WORDS joined in the usual ways, some with a number,
    and plain numbers and dates."""
    draw = lambda i, n: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n)).cast("int")
    words = F.array(*map(F.lit, WORDS))
    parts = F.slice(F.array(*[F.element_at(words, draw(i, len(WORDS)) + 1) for i in range(4)]), 1, draw(4, 3) + 2)
    title = F.transform(parts, lambda w: F.initcap(w))
    pascal = F.array_join(title, "")
    names = [F.array_join(parts, "_"), F.array_join(parts, "-"), F.array_join(parts, ""), pascal, F.concat(F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, 2, 99)), F.upper(F.array_join(parts, "_")), F.array_join(parts, "/")]
    ended = [F.when(draw(5, 4) == 0, F.concat(n, F.lit("_"), draw(6, 1000).cast("string"))).when(draw(5, 4) == 1, F.concat(n, draw(6, 10).cast("string"))).otherwise(n) for n in names]
    number = F.substring(F.translate(F.sha2(F.col("id").cast("string").cast("binary"), 256), "abcdef", "012345"), 1, draw(7, 13) + 4)
    day = F.date_add(F.lit("1990-01-01").cast("date"), draw(8, 20_000)).cast("string")
    return spark.range(SAMPLES).select(F.explode(F.array(*ended, number, day, F.concat_ws("-", F.substring(number, 1, 4), F.substring(number, 5, 4), F.substring(number, 9, 8)))).alias("token"), F.lit(1).alias("n"))


def transitions(counts: DataFrame, name: str) -> DataFrame:
    """pair and the log probability (column ``name``) of its second character after its first: the
    pair counts, of whose share BACKOFF goes by how often the second character occurs at all."""
    grid = counts.sparkSession.range(SYMBOLS * SYMBOLS).select(F.col("id").cast("int").alias("pair"), F.floor(F.col("id") / SYMBOLS).alias("head"), (F.col("id") % SYMBOLS).alias("tail"))
    full = grid.join(counts, "pair", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    heads = full.groupBy("head").agg(F.sum("n").alias("of_head"))
    tails = full.groupBy("tail").agg(F.sum("n").alias("of_tail"))
    tails = tails.withColumn("share", (F.col("of_tail") + 0.5) / (F.sum("of_tail").over(Window.partitionBy()) + 0.5 * SYMBOLS))
    p = (1 - BACKOFF) * F.col("n") / F.greatest("of_head", F.lit(1)) + F.when(F.col("of_head") > 0, BACKOFF).otherwise(1.0) * F.col("share")
    return full.join(heads, "head").join(tails, "tail").select("pair", F.ln(p).alias(name))


def log_ratios(ordinary: DataFrame, random: DataFrame) -> DataFrame:
    """One row: the log ratio of the random to the ordinary transition probability for every pair of
    characters. SYMBOLS ** 2 numbers, whatever the corpus."""
    both = transitions(ordinary, "o").join(transitions(random, "r"), "pair")
    rows = both.select(F.struct("pair", (F.col("r") - F.col("o")).alias("v")).alias("x"))
    return rows.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("ratios"))


def models(ws: Workspace, claimed: DataFrame) -> DataFrame:
    """``log_ratios`` of the labelled samples; ``claimed`` (token, n) adds to the random ones."""
    ordinary = ws.store(pair_counts(ordinary_samples(ws.spark)), rows=SYMBOLS**2)
    random = ws.store(pair_counts(claimed.unionByName(random_samples(ws.spark))), rows=SYMBOLS**2)
    return ws.store(log_ratios(ordinary, random), rows=1)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random for every row of documents.

    Tokens of JUDGED characters or more that overlap no base span are of kind ``random`` if their
    log-likelihood ratio reaches LEAST_TOTAL and LEAST_MEAN (reaching them exactly counts). Both models
    are trained from labelled samples: ordinary identifiers made by rule, and random strings made by
    rule with the values of all base spans of all documents; no other text trains them. Texts are
    read whole, once, however long. Spans that start together come in the order of KINDS. Null and
    empty texts have no spans; repeated rows equal results; other columns are ignored; an empty table
    gives no rows.
    """
    ws = Workspace(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = ws.store(rows.select("doc_id", spans.labelled(base_spans(F.col("text"))).alias("base"), spans.find(F.col("text"), TOKEN + "{%d,}" % JUDGED).alias("tokens")))
    claimed = found.select(F.explode("base").alias("s")).select(F.col("s.value").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    found = found.withColumn("ratios", models(ws, claimed).scalar())  # SYMBOLS ** 2 numbers

    def total(token: Column) -> Column:
        return F.aggregate(pair_codes(token), F.lit(0.0), lambda acc, p: acc + F.get("ratios", p))

    judged = F.transform(spans.outside(F.col("tokens"), F.col("base")), lambda s: F.struct(s.alias("s"), total(s["value"]).alias("ratio")))
    random = F.filter(judged, lambda x: (x["ratio"] >= LEAST_TOTAL) & (x["ratio"] >= LEAST_MEAN * (F.length(x["s"]["value"]) - 1)))
    added = F.transform(random, lambda x: F.struct(x["s"]["start"].alias("start"), F.lit(3).alias("rank"), x["s"]["end"].alias("end"), F.lit("random").alias("kind"), x["s"]["value"].alias("value")))
    every = F.when(F.size("tokens") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", added)))
    out = found.select("doc_id", "base", every.alias("every"))
    return out.select("doc_id", *(spans.count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]), spans.digest(F.col("base")).alias("base_sha256"), spans.joined(F.col("every")).alias("spans"), spans.count_kind(F.col("every"), "random").alias("n_random"))
