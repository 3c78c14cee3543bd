"""Quality by hierarchical empirical Bayes: the document's own evidence on top of its site's record.

Evidence: naive Bayes over binned rule statistics, trained by counting (statistic, bin, label) of
all labelled rows. Record: for every document a share of one good document (its label where there
is one, else its probability by evidence and the global prior) is summed by host and by path. A
path's posterior is shrunk toward its host's and a host's toward the global one, by strengths that
are estimated from how much hosts and paths differ beyond chance: sparse sites stay near the prior.
What a document itself added is taken out of its site's record before it is judged.

Tables of documents have no address: `source` is the host and `lang` the path, unless told else.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domgrove.llm.common import arrow_map, texts_of
from domgrove.llm.quality_rules import COUNTS, features, statistics
from domgrove.sources.tables import cut_lineage

BINS = 24


def binned(rows: np.ndarray) -> np.ndarray:
    """Bin numbers of statistics, finer near 0; a statistic is a share or a small number."""
    return np.clip(np.floor(np.log2(1 + 64 * np.maximum(rows, 0)) * 2.5), 0, BINS - 1).astype(np.int32)


def with_bins(docs: DataFrame, host: str, path: str) -> DataFrame:
    """doc_id, host, path and the bins of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                       F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                       F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                counts = statistics(texts_of(batch))
                yield {"bins": list(binned(features(counts)))} | {c: batch.column(c) for c in ("doc_id", "host", "path")}

    return arrow_map(rows, run, "doc_id long, host string, path string, bins array<int>")


def evidence_table(rows: DataFrame) -> tuple[list[list[float]], float]:
    """Log ratios by statistic and bin, and the log odds of good among labelled rows; from counts."""
    counts = (rows.filter("quality IS NOT NULL").select("quality", F.posexplode("bins").alias("k", "bin"))
              .groupBy("k", "bin").agg(F.sum("quality").alias("good"), F.count("*").alias("n")).collect())
    n_statistics = 1 + max((r["k"] for r in counts), default=-1)
    table = np.ones((n_statistics, BINS, 2)) * 0.5
    for r in counts:
        table[r["k"], r["bin"]] += (r["n"] - r["good"], r["good"])
    share = table / table.sum(1, keepdims=True)
    good = sum(r["good"] for r in counts if r["k"] == 0) + 1
    bad = sum(r["n"] - r["good"] for r in counts if r["k"] == 0) + 1
    return np.log(share[:, :, 1] / share[:, :, 0]).tolist(), float(np.log(good / bad))


def evidence(table: list[list[float]]) -> Column:
    """The sum of a row's log ratios."""
    if not table:
        return F.lit(0.0)
    parts = [F.element_at(F.array(*[F.lit(x) for x in column]), F.element_at("bins", k + 1) + 1)
             for k, column in enumerate(table)]
    return sum(parts[1:], parts[0])


def strength(groups: DataFrame) -> float:
    """Prior strength by moments: (own, n) of groups against the prior (prior) of each.

    The variance of shares around the prior, beyond what n documents scatter by chance, is
    p(1-p)/(s+1) for strength s.
    """
    r = groups.select(
        F.count("*").alias("k"),
        F.sum(F.expr("n * pow(own / n - prior, 2)")).alias("scatter"),
        F.sum(F.expr("prior * (1 - prior)")).alias("chance"),
        F.sum(F.expr("n * prior * (1 - prior)")).alias("most")).first()
    if not r["k"] or r["scatter"] is None:
        return 10.0
    between = (r["scatter"] - r["chance"]) / max(r["most"], 1e-9)  # about 1 / (s + 1)
    return float(min(1e6, max(1.0, 1 / max(between, 1e-6) - 1)))


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score (probability of good quality), kept.

    Null and empty texts are judged by the bins of zero counts; null hosts and paths are one of
    their own. Labels other than 0 and 1, and contradicting ones, are not used. Repeated rows are
    judged alike. Without labels the evidence is 0 and the prior one half.
    """
    known = (labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("other"))
             .filter("quality = other").drop("other"))
    rows = with_bins(docs, host, path)
    rows = cut_lineage(rows.join(known, F.col("doc_id") == F.col("id"), "left").drop("id"))
    table, odds = evidence_table(rows)
    rows = rows.select("doc_id", "host", "path", "quality", evidence(table).alias("evidence"))
    rows = rows.withColumn("own", F.coalesce(F.col("quality").cast("double"),
                                             F.expr(f"1 / (1 + exp(-least(greatest(evidence + {odds}, -40), 40)))")))
    paths = cut_lineage(rows.groupBy("host", "path").agg(F.sum("own").alias("path_own"), F.count("*").alias("path_n")))
    total = paths.agg(F.sum("path_own"), F.sum("path_n")).first()
    prior = (total[0] + 1) / (total[1] + 2) if total[1] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("path_own").alias("host_own"), F.sum("path_n").alias("host_n"))
    s_host = strength(hosts.select(F.col("host_own").alias("own"), F.col("host_n").alias("n"),
                                   F.lit(prior).alias("prior")))
    both = paths.join(hosts, "host")
    s_path = strength(both.select(F.col("path_own").alias("own"), F.col("path_n").alias("n"),
                                  F.expr(f"(host_own + {s_host * prior}) / (host_n + {s_host})").alias("prior")))
    judged = (rows.join(both, ["host", "path"])
              .withColumn("host_posterior", F.expr(f"(host_own - own + {s_host * prior}) / (host_n - 1 + {s_host})"))
              .withColumn("path_posterior", F.expr(f"(path_own - own + {s_path} * host_posterior) / (path_n - 1 + {s_path})"))
              .withColumn("p", F.expr("least(greatest(path_posterior, 1e-9), 1 - 1e-9)"))
              .withColumn("score", F.expr("1 / (1 + exp(-least(greatest(evidence + ln(p / (1 - p)), -40), 40)))")))
    return judged.select("doc_id", "evidence", "host_posterior", "path_posterior", "score",
                         (F.col("score") >= 0.5).alias("kept"))
