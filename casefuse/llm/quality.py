"""Learned decision lists over text statistics.

Statistics are counted over whole texts. From labelled rows, sequential covering learns an ordered
list of threshold conjunctions that reject: each rule is grown on two thirds of the rows by
information gain, pruned from its end on the other third, and kept only if it is precise there;
the rows it covers are then taken away. The list is applied as one ordered Spark conditional.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse.llm.common import mix64, packed, unpacked, utf8, written

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "n_lines", "n_upper", "n_digits", "n_distinct", "n_marks"]
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?;:.,"
_SPACES = b" \t\n\v\f\r"


def _without(text: bytes, drop: bytes) -> int:
    return len(text) - len(text.translate(None, drop))


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Word positions covered by a run of `width` words that occurs at least twice."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    run = ids[:n].astype(np.int64)
    for step in range(1, width):
        run = run * (int(ids.max()) + 1) + ids[step:step + n]
        if step < width - 1 and run.max() > 1 << 40:
            run = np.unique(run, return_inverse=True)[1]
    order = np.argsort(run, kind="stable")
    same = run[order][1:] == run[order][:-1]
    twice = np.zeros(n + 1, bool)
    twice[:-1][order[1:][same]] = True
    twice[:-1][order[:-1][same]] = True
    at = np.flatnonzero(twice)
    covered = np.zeros(len(ids), bool)
    for step in range(width):
        covered[at + step] = True
    return int(covered.sum())


def text_stats(text: bytes) -> tuple:
    """The numbers named in STATS."""
    words = text.split()
    seen = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [line for line in text.split(b"\n") if line.strip(_SPACES)]
    solid = text.translate(None, _SPACES)
    return (len(words), len(solid.decode()), _without(text, SYMBOLS.encode()),
            len(lines) - len(set(lines)), repeated_words(ids), len(lines),
            _without(text, _UPPER), _without(text, _DIGITS), len(seen), _without(text, _MARKS))


def stats(text: Column) -> Column:
    """STATS of a text as one struct; null counts as empty."""
    @F.arrow_udf("struct<" + ", ".join(f"{name}: long" for name in STATS) + ">")
    def counted(texts: pa.Array) -> pa.Array:
        rows = np.array([text_stats(t or b"") for t in utf8(texts)], np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(c) for c in rows.reshape(-1, len(STATS)).T], STATS)
    return counted(text)


def base_failed(s) -> Column:
    """The two fixed rules: too short, or more than half of the words in repeated runs."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(s) -> dict[str, Column]:
    """Scale-free features of a statistics struct; a text without words has 0 everywhere."""
    def per(part, whole):
        return F.when(s[whole] > 0, s[part] / s[whole]).otherwise(F.lit(0.0))
    return {
        "n_words": s["n_words"].cast("double"), "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"), "upper": per("n_upper", "word_chars"),
        "digits": per("n_digits", "word_chars"), "distinct": per("n_distinct", "n_words"),
        "marks": per("n_marks", "n_words"), "line_words": per("n_words", "n_lines")}


@dataclass(frozen=True)
class Test:
    """`feature <= limit`, or `feature > limit` where `above`."""
    feature: str
    above: bool
    limit: float

    def covers(self, table: dict) -> np.ndarray:
        v = table[self.feature]
        return v > self.limit if self.above else v <= self.limit


def _covers(rule, table, n):
    out = np.ones(n, bool)
    for test in rule:
        out &= test.covers(table)
    return out


def _best_test(table, bad, limits):
    """The test with the largest gain in information about `bad`, None if none gains."""
    p0, n0 = bad.sum(), (~bad).sum()
    best, found = 0.0, None
    for name, cuts in limits.items():
        order = np.argsort(table[name], kind="stable")
        below_p = np.concatenate([[0], np.cumsum(bad[order])])
        at = np.searchsorted(table[name][order], cuts, side="right")
        for above in (False, True):
            p = p0 - below_p[at] if above else below_p[at]
            n = (len(bad) - at if above else at) - p
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1))
                                        - np.log2(p0 / (p0 + n0))), 0.0)
            i = int(np.argmax(gain)) if len(gain) else -1
            if i >= 0 and gain[i] > best + 1e-9:
                best, found = float(gain[i]), Test(name, above, float(cuts[i]))
    return found


def _halfway(values: np.ndarray, cuts: int) -> np.ndarray:
    """Thresholds between neighbouring values at about `cuts` quantiles."""
    steps = np.unique(values)
    at = np.unique(np.searchsorted(steps, np.quantile(
        values, np.linspace(0, 1, cuts + 1), method="lower")))
    at = at[at + 1 < len(steps)]
    return (steps[at] + steps[at + 1]) / 2


def learn(table: dict, bad: np.ndarray, grow: np.ndarray, precision: float = 0.95,
          least: int = 3, tests: int = 4, cuts: int = 64) -> list:
    """Ordered reject rules, each a tuple of Tests.

    `table` maps features to arrays, `bad` marks the rows to reject, `grow` the rows to grow on
    (the others prune). A rule needs `least` rejected rows and `precision` on the pruning rows;
    the first that fails ends the list. Thresholds are tried at about `cuts` quantiles of a feature,
    each halfway to the next larger value.
    """
    limits = {k: _halfway(v, cuts) for k, v in table.items()}
    left, rules = np.ones(len(bad), bool), []

    def part(where):
        return {k: v[where] for k, v in table.items()}

    while (left & grow & bad).any():
        rule, inside = [], left & grow
        while len(rule) < tests and (inside & ~bad).any():
            test = _best_test(part(inside), bad[inside], limits)
            if test is None:
                break
            rule.append(test)
            inside &= test.covers(table)
        held = left & ~grow
        worth = []
        for k in range(1, len(rule) + 1):
            c = _covers(rule[:k], table, len(bad)) & held
            p, n = int((c & bad).sum()), int((c & ~bad).sum())
            worth.append(((p - n) / (p + n) if p + n else -1.0, p, n, k))
        if not worth:
            break
        _, p, n, k = max(worth, key=lambda x: (x[0], x[1], -x[3]))
        if p < least or p < precision * (p + n):
            break
        rules.append(tuple(rule[:k]))
        left &= ~_covers(rules[-1], table, len(bad))
    return rules


def verdict(rules: list, s) -> Column:
    """Keep or reject as an ordered conditional; rows that no rule covers are kept."""
    f, out = features(s), None
    for rule in rules:
        holds = F.lit(True)
        for t in rule:
            holds = holds & ((f[t.feature] > t.limit) if t.above else (f[t.feature] <= t.limit))
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_rules(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                max_labelled: int = 20000, **how) -> list:
    """Rules learned from counted rows (`id_col` and struct `stats`) and `labels(doc_id, quality)`.

    Quality 0 rejects, 1 keeps; other and null labels are passed over, and so are rows that the
    fixed rules reject already. Of more than `max_labelled` rows a part of about that size, chosen
    by a hash of the id, is used. Without rows of both kinds the list is empty.
    """
    s = F.col("stats")
    judged = labels.where(F.col("quality").isin(0, 1)).select(
        F.col("doc_id").alias("id"), "quality").dropna()
    rows = counted.where(~base_failed(s)).select(
        F.col(id_col).alias("id"), *[c.alias(k) for k, c in features(s).items()]).join(judged, "id")
    rows, seen = written(rows, "labelled", n=F.count(F.lit(1)))
    n = seen["n"]
    if n > max_labelled:
        rows = rows.where(F.pmod(mix64(F.col("id"), seed=11), F.lit(1 << 30))
                          < int((1 << 30) * max_labelled / n))
    rows = sorted(rows.collect())
    names = list(features(s))
    table = {k: np.array([r[k] for r in rows], float) for k in names}
    bad = np.array([r["quality"] == 0 for r in rows], bool)
    if not bad.any() or bad.all():
        return []
    return learn(table, bad, np.arange(len(bad)) % 3 != 0, **how)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_labelled: int = 20000) -> DataFrame:
    """`doc_id`, the statistics, `base_failed` and `kept` of every row.

    A null text is empty: no words, base_failed. Repeated rows each give a row, a null id never
    meets a label, an empty table gives no rows, further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), stats(F.col(text_col)).alias("stats"))
    rows = written(rows, "stats")
    rules = learn_rules(rows, labels, max_labelled=max_labelled)
    s = F.col("stats")
    return rows.select("doc_id", *[s[k].alias(k) for k in STATS[:5]],
                       base_failed(s).alias("base_failed"),
                       (~base_failed(s) & verdict(rules, s)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
              text_col: str = "text", max_labelled: int = 20000) -> DataFrame:
    """The rows of `docs` that neither the fixed nor the learned rules reject, unchanged.

    Statistics are taken twice, once to learn and once to judge, so that texts are not written.
    """
    text = stats(F.col(f"`{text_col}`")).alias("stats")
    counted = written(docs.select(F.col(f"`{id_col}`").alias("id"), text), "stats")
    rules = learn_rules(counted, labels, "id", max_labelled)
    s = F.col("stats")
    rows = packed(docs, text)
    return unpacked(rows.where(~base_failed(s) & verdict(rules, s)), docs.columns)
