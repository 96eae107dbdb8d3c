"""Token counts by an exact length histogram.

Every document is encoded whole; only its number of tokens leaves the task, and documents are
aggregated by group and length. Suffix sums over the lengths then answer, for every context limit:
how many documents and tokens are at least that long, what a corpus holds when each document is cut
there, and any quantile. The histogram is summed in two steps, within blocks of neighbouring lengths
and over the blocks, so no task has to read all lengths of a group.

Defined cases: a null or empty text has length 0. A null group is a group of its own. Repeated rows
count each. A very long text is encoded whole by one task. Documents of equal length are one row, so ties need no order. Further columns
are read only if they are named, and may have any name but those starting with ``__``. An empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encoder
from .common import stored

BLOCK = 1024
#: What the report answers for each language and for all documents.
LIMITS, QUANTILES = (512, 2048, 8192, 32768), (0.5, 0.9, 0.99)


def count_tokens(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = (), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The kept columns of each document and ``n_tokens``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path, pattern)
        for batch in batches:
            sizes = [len(ids) for ids in coder.encode_batch(batch["__text"].tolist())]
            yield batch.drop(columns="__text").assign(n_tokens=pd.array(sizes, dtype="int64"))

    rows = docs.select(*keep, F.col(text_column).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "__text")
    return rows.mapInPandas(run, f"{fields}n_tokens long")


def histogram(counted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents of each length, and the suffix sums.

    ``docs_from``, ``tokens_from``: documents of at least this length and their tokens;
    ``docs_total``, ``tokens_total``: of the group; ``tokens_cut``: what the group holds when every
    document is cut at this length.
    """
    return suffix_sums(length_bins(counted, by), by)


def length_bins(counted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents of each length, stored, as each use would encode the documents anew."""
    return stored(counted.groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "length-bins")


def suffix_sums(bins: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The histogram of stored bins, with the suffix sums that ``histogram`` tells of."""
    bins = bins.withColumn("__block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("__tokens", F.col("n_docs") * F.col("n_tokens"))
    blocks = bins.groupBy(*by, "__block").agg(F.sum("n_docs").alias("__d"), F.sum("__tokens").alias("__t"))
    whole = W.partitionBy(*by)
    beyond = whole.orderBy(F.desc("__block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        *[F.col(c).alias(f"__by_{c}") for c in by],
        F.col("__block").alias("__b"),
        F.coalesce(F.sum("__d").over(beyond), F.lit(0)).alias("__docs_beyond"),
        F.coalesce(F.sum("__t").over(beyond), F.lit(0)).alias("__tokens_beyond"),
        F.sum("__d").over(whole).alias("docs_total"),
        F.sum("__t").over(whole).alias("tokens_total"),
    )
    same = F.col("__block") == F.col("__b")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    inside = W.partitionBy(*by, "__block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    out = (
        bins.withColumn("docs_from", F.sum("n_docs").over(inside))
        .withColumn("tokens_from", F.sum("__tokens").over(inside))
        .join(blocks, same)
        .withColumn("docs_from", F.col("docs_from") + F.col("__docs_beyond"))
        .withColumn("tokens_from", F.col("tokens_from") + F.col("__tokens_beyond"))
    )
    cut = F.col("tokens_total") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")
    return out.select(*by, "n_tokens", "n_docs", "docs_from", "tokens_from", "docs_total", "tokens_total", cut.alias("tokens_cut"))


def truncated_total(hist: DataFrame, limits: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """For each group and limit: the tokens left when documents are cut there.

    A limit between two lengths counts from the next longer one: all documents from there on are cut.
    """
    asked = hist.select("*", F.explode(F.array(*[F.lit(x).cast("long") for x in sorted(set(limits))])).alias("context_limit"))
    longer = F.col("n_tokens") >= F.col("context_limit")
    suffix = F.min_by(F.when(longer, F.struct("docs_from", "tokens_from")), F.when(longer, F.col("n_tokens")))
    cut = asked.groupBy(*by, "context_limit").agg(F.first("tokens_total").alias("tokens_total"), suffix.alias("s"))
    saved = F.col("s.tokens_from") - F.col("s.docs_from") * F.col("context_limit")
    return cut.select(*by, "context_limit", (F.col("tokens_total") - F.coalesce(saved, F.lit(0))).alias("tokens_cut"))


def quantile(hist: DataFrame, q: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group the smallest length that at least a share ``q`` of its documents do not exceed."""
    reached = F.col("docs_total") - F.col("docs_from") + F.col("n_docs") >= F.ceil(F.lit(q) * F.col("docs_total"))
    return hist.where(reached).groupBy(*by).agg(F.min("n_tokens").alias("n_tokens"))


def answers(hist: DataFrame, by: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """A row for each group: documents, tokens, the quantiles, and the tokens left at each limit, all from the suffix sums."""
    c = F.col
    known = [F.first("docs_total").alias(f"{prefix}docs"), F.first("tokens_total").alias(f"{prefix}tokens")]
    for q in QUANTILES:
        reached = c("docs_total") - c("docs_from") + c("n_docs") >= F.ceil(F.lit(q) * c("docs_total"))
        known.append(F.min(F.when(reached, c("n_tokens"))).alias(f"{prefix}p{round(100 * q)}"))
    for limit in LIMITS:
        longer = c("n_tokens") >= limit
        next_ = F.min_by(F.when(longer, c("tokens_from") - c("docs_from") * limit), F.when(longer, c("n_tokens")))
        known.append((F.first("tokens_total") - F.coalesce(next_, F.lit(0))).alias(f"{prefix}cut_{limit}"))
    return hist.groupBy(*by).agg(*known)


def report(docs: DataFrame) -> DataFrame:
    """The histogram of all documents for each language, with its suffix sums.

    Beside them stand the answers to ``QUANTILES`` and ``LIMITS``, for the language (``lang_...``) and for all documents (``all_...``).
    """
    bins = length_bins(count_tokens(docs, keep=("lang",)), ("lang",))
    hist = suffix_sums(bins, ("lang",))
    every = suffix_sums(stored(bins.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "all-length-bins"))
    each = answers(hist, ("lang",), "lang_").withColumnRenamed("lang", "__lang")
    whole = answers(every, (), "all_").first()  # one row
    joined = hist.join(each, F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang")
    return joined.select("*", *[F.lit(value).cast("long").alias(name) for name, value in whole.asDict().items()])
