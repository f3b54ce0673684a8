"""URL verdicts: host and path rules first, a character language-model ratio for the rest.

Two variable-order Markov models over characters are counted on the URLs that the rules accept and
reject. A context of up to three characters backs off, smoothed by the number of different followers,
to the next shorter one. A URL is accepted if its mean log ratio per character reaches a threshold that
is calibrated on a part of the ruled URLs that the models did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
#: 32 symbols: 0 start, 1-26 letters, 27 digits, 28 hyphen, 29 dot, 30 slash, 31 anything else.
SYMBOLS = 32
_CODE = np.full(256, 31, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[48:58] = 27
_CODE[ord("-")], _CODE[ord(".")], _CODE[ord("/")] = 28, 29, 30
#: One part in FOLDS of the ruled URLs calibrates the threshold.
FOLDS, STEPS, RANGE = 4, 2000, 4.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    ascii_low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = F.coalesce(ascii_low(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def with_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, url, host, path and, where a rule fits, rule and verdict (else null). The longest rule wins.

    The rule list is a parameter of the job, not data: it becomes one expression.
    """
    slim = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    slim = slim.withColumns({"host": host, "path": path})
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path))

    def first(value) -> Column:
        out = None
        for r in ordered:
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            out = F.when(fits, F.lit(value(r))) if out is None else out.when(fits, F.lit(value(r)))
        return F.lit(None).cast("string") if out is None else out

    return slim.withColumns({"rule": first(lambda r: r.host + r.path), "verdict": first(lambda r: r.verdict)})


def _codes(url: str | None) -> np.ndarray:
    """Index of every run of ORDER + 1 symbols, the URL padded with start symbols; scheme and `://` are left out."""
    raw = np.frombuffer((url or "").split("://", 1)[-1].lower().encode("utf-8", "replace"), np.uint8)
    s = np.concatenate([np.zeros(ORDER, np.int64), _CODE[raw]])
    k = np.zeros(len(raw), np.int64)
    for j in range(ORDER + 1):
        k = k * SYMBOLS + s[j:j + len(raw)]
    return k


def _counts(urls: DataFrame) -> dict[str, np.ndarray]:
    """Counts of runs per verdict over all rows (__url, verdict). At most two tables of SYMBOLS ** 4 reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {v: np.zeros(SYMBOLS ** (ORDER + 1), np.int64) for v in ("allow", "block")}
        for b in batches:
            d = b.to_pydict()
            for v in total:
                runs = [_codes(u) for u, w in zip(d["__url"], d["verdict"], strict=True) if w == v]
                if runs:
                    np.add.at(total[v], np.concatenate(runs), 1)
        for v, t in total.items():
            at = t.nonzero()[0]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(at)), pa.array(at.astype(np.int32)), pa.array(t[at])], ["verdict", "i", "n"])

    rows = urls.select("__url", "verdict").mapInArrow(run, "verdict string, i int, n long").groupBy("verdict", "i").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for v in ("allow", "block"):
        out[v] = np.zeros(SYMBOLS ** (ORDER + 1))
        part = rows[rows["verdict"] == v]
        out[v][part["i"].to_numpy(np.int64)] = part["n"].to_numpy(np.float64)
    return out


def _log_model(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | up to ORDER symbols before it), shorter contexts smoothing longer ones."""
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(ORDER + 1):
        c = counts.reshape(-1, SYMBOLS ** order, SYMBOLS).sum(0)           # context of `order` symbols, follower
        lower = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if order else 1, 1))[: len(c)]
        kinds = (c > 0).sum(1, keepdims=True)
        seen = c.sum(1, keepdims=True)
        p = np.where(seen > 0, (c + kinds * lower) / np.maximum(seen + kinds, 1), lower)
    return np.log(p).ravel()


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float

    def scores(self, urls: list[str | None]) -> np.ndarray:
        """Mean log ratio per character; 0 for null and empty URLs."""
        runs = [_codes(u) for u in urls]
        n = np.array([len(r) for r in runs])
        if not n.sum():
            return np.zeros(len(urls))
        sums = np.add.reduceat(np.append(self.ratio[np.concatenate(runs)], 0.0), np.minimum(np.concatenate([[0], n.cumsum()[:-1]]), n.sum()))
        return np.where(n > 0, sums / np.maximum(n, 1), 0.0)


def _score(df: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)
    slim = df.select("__url", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(shared.value.scores(b.column(0).to_pylist()))], [*b.schema.names[1:], "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[1:])
    return slim.mapInArrow(run, f"{kinds}, score double")


def fit(ruled: DataFrame) -> Model:
    """Models and threshold from all URLs that a rule decides (rows __url, verdict not null).

    The threshold is the score that parts accepted and rejected calibration URLs best, both kinds weighing the same;
    the middle of equally good cuts. Without ruled URLs of both kinds it is 0 and nothing is blocked by the method.
    """
    fold = F.pmod(F.xxhash64("__url"), F.lit(FOLDS))
    counts = _counts(ruled.filter(fold > 0))
    if not all(c.sum() for c in counts.values()):
        return Model(np.zeros(SYMBOLS ** (ORDER + 1)), 0.0)
    model = Model(_log_model(counts["allow"]) - _log_model(counts["block"]), 0.0)
    step = F.least(F.greatest(F.floor((F.col("score") + RANGE) / (2 * RANGE) * STEPS), F.lit(0)), F.lit(STEPS - 1)).cast("int")
    seen = _score(ruled.filter(fold == 0), model, ["verdict"]).groupBy("verdict", step.alias("b")).count().collect()
    hist = {v: np.zeros(STEPS) for v in ("allow", "block")}
    for r in seen:
        hist[r["verdict"]][r["b"]] = r["count"]
    if all(h.sum() for h in hist.values()):
        # right at a cut below step b: rejected ones under it, accepted ones from it on
        good = (np.concatenate([[0], hist["block"].cumsum()]) / hist["block"].sum()
                + 1 - np.concatenate([[0], hist["allow"].cumsum()]) / hist["allow"].sum())
        best = (good >= good.max() - 1e-12).nonzero()[0]
        model.threshold = float(best[len(best) // 2]) / STEPS * 2 * RANGE - RANGE
    return model


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, score.

    The verdict is the longest fitting rule's, else allow if the score reaches the calibrated threshold. A null or empty URL has
    score 0. Keys, null or repeated, pass as they are.
    """
    ruled = with_rules(pages, rules, key=key, url=url)
    model = fit(ruled.filter("verdict is not null"))
    scored = _score(ruled, model, ["__key", "host", "path", "rule", "verdict"])
    by_score = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    return scored.select(F.col("__key").alias(key), "host", "path", "rule", F.coalesce("verdict", by_score).alias("verdict"), "score")
