"""URL filter: rules first, then the ratio of two character language models.

Rules give every url they fit a verdict. Those urls, accepted and rejected, train one smoothed variable-order
Markov model each: the chance of a character after its context is interpolated from the longest context down
to single characters (Witten-Bell: a context that was followed by T kinds of characters in n places gives the
shorter context the weight T / (n + T)). A url without a rule is scored by the mean log ratio per character of
the two models; it is blocked below a threshold that is calibrated on urls held out of training, where it
maximises the mean of the two classes' accuracies.

The models are fitted on all distinct urls under a rule but those held out, one in ``HELD_OUT`` by hash, and the threshold on
all held out; a url counts once however often it stands in the pages. A position of a url is a window of characters, one
number, that holds its context of every length. Windows are counted, their log ratios worked out from the counts of all
lengths and brought to the urls by joins, so no model is held in one place. Ratios are added up as fixed-point numbers, so a
score does not depend on the order of rows. With no urls of one class, all scores are 0.

Defined cases: host and path are empty for a null url or one without ``://``; no rule fits, and with nothing to
score the score is 0 and the threshold decides; repeated rows are judged each; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import textkernel as K
from ledgerlens.llm.common import ship, store

#: (host, path prefix, verdict); the longest fitting rule wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
ORDER, HELD_OUT = 5, 5
#: A character of a window (a byte, 256 before the url, 257 at its end) takes ``BITS``; ratios are kept in units of 1 / ``UNIT``.
BITS, UNIT = 9, 2.0**32
CLASSES = ("allowed", "blocked")


def parts(pages: DataFrame) -> DataFrame:
    """Add host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return pages.withColumn("host", host).withColumn("path", path)


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """Add rule (the longest fitting one, as host and path) and ruling."""
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, ruling = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruling)
    return rows.withColumn("rule", rule).withColumn("ruling", ruling)


def _grams(text, order):
    """(hash of context, hash of context and character) of every character, for every context length."""
    # Two bytes before the url mark its start; a zero byte marks its end.
    codes = np.concatenate([np.full(order, 256), np.frombuffer(text.encode(), np.uint8).astype(np.int64), [257]])
    mixed = K.mix(codes.astype(K.U) + K.U(1))
    n = len(codes) - order
    out = []
    context = np.zeros(n, K.U)
    for k in range(order + 1):
        if k:
            context = K.mix(context * K.U(3) + mixed[order - k : order - k + n] + K.U(k))
        out.append((context, K.mix(context + mixed[order:] * K.U(5))))
    return out


def scored_part(url):
    """What the models see: host, path and the rest, not the scheme."""
    return url.partition("://")[2] if url else ""


class CharacterModel:
    """Sorted arrays of n-gram and context counts of one class: the model of a few urls in memory, which the tests compare with."""

    def __init__(self, context, gram, count):
        order = np.argsort(gram)
        self.gram, self.count = gram[order], count[order]
        self.context, inverse, self.kinds = np.unique(context, return_inverse=True, return_counts=True)
        self.total = np.bincount(inverse, count, len(self.context))

    @staticmethod
    def _find(keys, values, wanted):
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0)

    def log_chance(self, grams):
        """Natural log of the chance of each character, the longest context first to give way."""
        chance = 1 / 258
        for context, gram in grams:
            context, gram = K.signed(context), K.signed(gram)
            n, kinds = self._find(self.context, self.total, context), self._find(self.context, self.kinds, context)
            seen = self._find(self.gram, self.count, gram)
            chance = np.where(n > 0, (seen + kinds * chance) / np.maximum(n + kinds, 1), chance)
        return np.log(chance)


def score(url, models, order):
    """Mean log ratio per character, the end included; 0 for an empty url."""
    text = scored_part(url)
    if not text or len(models) < 2:
        return 0.0
    grams = _grams(text, order)
    return float((models[True].log_chance(grams) - models[False].log_chance(grams)).mean())


def windows(texts, order):
    """(number of the text, window) of every character of some texts (bytes) and of their ends."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.full(int(lengths.sum()) + (order + 1) * len(texts), 256, np.int64)
    number = np.repeat(np.arange(len(texts)), lengths)
    codes[np.arange(len(number)) + (number + 1) * order + number] = np.frombuffer(b"".join(texts), np.uint8)
    codes[np.cumsum(lengths) + np.arange(1, len(texts) + 1) * (order + 1) - 1] = 257
    n = len(codes) - order
    window = np.zeros(n, np.int64)
    for k in range(order + 1):
        window = (window << BITS) | codes[k : k + n]
    # Windows that end before a url are none of its own.
    return np.repeat(np.arange(len(texts)), lengths + 1), window[codes[order:] != 256]


def _spell(batches, order):
    """The first column of each text's row and its windows, from rows of (anything, text)."""
    for batch in batches:
        if batch.num_rows:
            number, window = windows(batch.column(1).to_pylist(), order)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(number)), pa.array(window)], [batch.schema.names[0], "window"])


def spelled(urls: DataFrame, kept: str, order: int) -> DataFrame:
    """(``kept``, window) of every position of the urls' texts."""
    ship(urls.sparkSession)
    rows = urls.select(kept, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(partial(_spell, order=order), f"{rows.schema[kept].simpleString().replace(':', ' ')}, window long")


def _end(window: str, length: int) -> Column:
    """The last characters of a window."""
    return F.col(window).bitwiseAND(F.lit((1 << BITS * length) - 1))


def _by_length(rows: DataFrame, order: int, *more: str) -> DataFrame:
    """Every window once per length of context, as (length, gram)."""
    ends = F.array(*[F.struct(F.lit(k).alias("length"), _end("window", k + 1).alias("gram")) for k in range(order + 1)])
    return rows.select(F.inline(ends), *more)


def fit(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(length, gram, allowed, blocked): how often each gram of every length stands in the urls of (accepted, text) rows."""
    counts = spelled(labelled, "accepted", order).groupBy("window").agg(F.count_if("accepted").alias("allowed"), F.count_if(~F.col("accepted")).alias("blocked"))
    return store(_by_length(counts, order, *CLASSES).groupBy("length", "gram").agg(*[F.sum(c).alias(c) for c in CLASSES]))


def ratios(wanted: DataFrame, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(window, ratio) of the wanted distinct windows: the log ratio of the two models, in units of 1 / ``UNIT``.

    A chance is ``share + rest * chance after the shorter context``; both are worked out once per gram and put together from
    the shortest context on. A gram goes on to at most one of each character, so no join has a hot key.
    """
    contexts = grams.groupBy("length", F.shiftright("gram", BITS).alias("context")).agg(
        *[F.sum(c).alias(f"{c}_n") for c in CLASSES], *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in CLASSES]
    )
    needed = _by_length(wanted, order).distinct().withColumn("context", F.shiftright("gram", BITS))
    found = needed.join(grams, ["length", "gram"], "left").join(contexts, ["length", "context"], "left")
    # A context that a class has not seen leaves the chance to the shorter one.
    seen, weight = (lambda c: F.coalesce(c, F.lit(0))), (lambda c: F.col(f"{c}_n") + F.col(f"{c}_kinds"))
    share = [F.when(F.col(f"{c}_n") > 0, seen(c) / weight(c)).otherwise(0.0).alias(f"{c}_share") for c in CLASSES]
    rest = [F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_kinds") / weight(c)).otherwise(1.0).alias(f"{c}_rest") for c in CLASSES]
    steps = store(found.select("length", "gram", *share, *rest))
    chances = None
    for k in range(order + 1):
        step = steps.where(F.col("length") == k).withColumn("shorter", _end("gram", k))
        before = {c: F.lit(1 / 258) if chances is None else F.col(c) for c in CLASSES}
        if chances is not None:
            step = step.join(chances.withColumnRenamed("gram", "shorter"), "shorter")
        chances = step.select("gram", *[(F.col(f"{c}_share") + F.col(f"{c}_rest") * before[c]).alias(c) for c in CLASSES])
    return store(chances.select(F.col("gram").alias("window"), F.rint(F.log(F.col("allowed") / F.col("blocked")) * UNIT).cast("long").alias("ratio")))


def scored(urls: DataFrame, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(id, score) of urls (id, text): the mean log ratio per character, the end included."""
    at = spelled(urls, "id", order)
    ratio = ratios(at.select("window").distinct(), grams, order)
    return at.join(ratio, "window").groupBy("id").agg((F.sum("ratio") / F.count("*") / UNIT).alias("score"))


def threshold(held: DataFrame) -> float:
    """The cut of (score, accepted) rows with the best mean of both classes' accuracies; 0 without urls of both.

    Equal scores are one row; rows are put in order by ranges, and each range starts from the sums of those before it.
    """
    right, wrong = F.count_if(~F.col("accepted")), F.count_if("accepted")
    rows = held.groupBy("score").agg(right.alias("right"), wrong.alias("wrong"))
    placed = store(rows.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("part").agg(F.sum("right").alias("right_before"), F.sum("wrong").alias("wrong_before"))
    total = sums.agg(F.sum("right_before"), F.sum("wrong_before")).first()
    if not total[0] or not total[1]:
        return 0.0
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("right_before", "wrong_before")])
    within = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    # Blocking up to a score: rejected among them are right, accepted among them wrong; in whole numbers, times both totals.
    gain = [((F.col(f"{c}_before") + F.sum(c).over(within)).cast("decimal(19,0)") * F.lit(other).cast("decimal(19,0)")) for c, other in (("right", total[1]), ("wrong", total[0]))]
    best = placed.join(F.broadcast(before), "part").select("score", (gain[0] - gain[1]).alias("gain")).orderBy(F.desc("gain"), "score").first()
    # Between the two scores that the best cut parts, as near to 0 as may be.
    low = best["score"] if best["gain"] > 0 else -np.inf
    high = placed.where(F.col("score") > F.lit(low)).agg(F.min("score")).first()[0]
    return float(min(max(0.0, np.nextafter(low, np.inf)), np.inf if high is None else high))


def _bounded(labelled: DataFrame, n: int | None) -> DataFrame:
    """All distinct urls, or, where the caller gives a number, so many of each class by hash."""
    if n is None:
        return labelled
    return labelled.where("accepted").orderBy(F.xxhash64("url"), "url").limit(n).union(labelled.where("not accepted").orderBy(F.xxhash64("url"), "url").limit(n))


def judge(pages: DataFrame, rules=RULES, order: int = ORDER, train: int | None = None) -> DataFrame:
    """page_id, url, host, path, rule, score (null under a rule) and verdict of every page.

    All labelled urls are learned from; only a caller that gives ``train`` bounds them, for trials.
    """
    rows = store(ruled(parts(pages.select("page_id", "url")), rules))
    text = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    urls = rows.where("url is not null").select("url", (F.col("ruling") == "allow").alias("accepted")).distinct()
    held = F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(HELD_OUT)) == 0
    urls = store(urls.select(F.monotonically_increasing_id().alias("id"), "url", "accepted", text.alias("text"), held.alias("held")))
    labelled = urls.where("accepted is not null")
    grams = fit(_bounded(labelled.where("not held"), train), order)
    known = grams.agg(F.max("allowed"), F.max("blocked")).first()
    calibrated = _bounded(labelled.where("held"), train and train // HELD_OUT)
    open_urls = urls.where("accepted is null").unionByName(calibrated)
    if known[0] and known[1]:
        scores = store(open_urls.join(scored(open_urls.where("text <> ''"), grams, order), "id", "left").select("url", "accepted", F.coalesce("score", F.lit(0.0)).alias("score")))
    else:
        scores = open_urls.select("url", "accepted", F.lit(0.0).alias("score"))
    cut = threshold(scores.where("accepted is not null"))
    free = rows.where("rule is null").drop("ruling").join(scores.where("accepted is null").select("url", "score"), "url", "left")
    free = free.withColumn("score", F.coalesce("score", F.lit(0.0)))
    free = free.withColumn("verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    fixed = rows.where("rule is not null").withColumn("score", F.lit(None).cast("double")).withColumn("verdict", F.col("ruling")).drop("ruling")
    return fixed.unionByName(free)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")
