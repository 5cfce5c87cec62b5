"""Quality rules: statistics of whole texts by Spark expressions, and a decision list learned from labels.

Sequential covering grows one conjunction of thresholds at a time on two thirds of the labelled
documents, prunes it on the rest, takes it if it is precise enough there, removes what it covers and starts
again. The list comes out as one ordered conditional expression. The labelled documents are a bounded
sample: learning happens on the driver, everything that runs over the corpus is a Spark expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Statistics that rules may test, each derived from the counts of `measured`.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "bar_share", "digit_share", "mean_line", "listed_words", "listed_share")


def _bound(value: Column, f) -> Column:
    """Give a value to a function through a lambda variable, so that it is computed once."""
    return F.transform(F.array(value), f)[0]


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    Windows are compared by a 64-bit hash. Texts without a repeat end at one hash set; in the others, windows are
    sorted by hash, those equal to a neighbour are put back in text order, and overlaps are taken off.
    """

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(3), s - a["last"])).alias("n"))
        return F.aggregate(starts, first, step, lambda a: a["n"])

    def repeated(codes: Column) -> Column:
        pairs = F.sort_array(F.transform(codes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = lambda s: F.filter(s, lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == x["h"])))
        return covered(F.sort_array(F.transform(_bound(pairs, near), lambda x: x["i"])))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    count = lambda codes: F.when(F.size(F.array_distinct(codes)) == F.size(codes), 0).otherwise(repeated(codes))
    return _bound(words, lambda w: F.when(F.size(w) < 3, 0).otherwise(_bound(windows(w), count)))


def measured(docs: DataFrame, listed: list[str], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and FEATURES, of every whole text.

    Words are separated by blanks and \\x09-\\x0D. Null texts have no words; all their counts are 0. `listed` are words
    whose occurrences (letters only, in lower case) are counted.
    """
    body = F.coalesce(docs[f"`{text}`"], F.lit(""))
    words = F.filter(F.split("body", f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    kept = lambda characters: F.length("body") - F.length(F.translate("body", characters, ""))
    inside = lambda pattern: F.length(F.regexp_replace("body", f"[^{pattern}]+", ""))
    found = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), body.alias("body"))
    names = F.split(F.lower(F.regexp_replace("body", r"[^\p{L}]+", " ")), " ")
    hits = F.size(F.filter(names, lambda w: w.isin(*listed))) if listed else F.lit(0)
    found = found.select(
        "doc_id",
        words.alias("words"),
        F.length(F.regexp_replace("body", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        kept("#*$%&|<>").cast("long").alias("n_symbols"),
        _bound(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("dup"), F.size(x).alias("n"))).alias("lines"),
        inside(r"\p{Lu}").alias("upper"), kept("!").alias("bangs"), kept("|").alias("bars"), inside("0-9").alias("digits"), hits.cast("long").alias("hits"),
    )
    found = found.select("*", F.size("words").cast("long").alias("n_words"), F.col("lines.dup").cast("long").alias("n_dup_lines"), _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"))
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))
    lines_per = lambda x: F.when(F.col("lines.n") > 0, x / F.col("lines.n")).otherwise(F.lit(0.0))
    features = {
        "n_words": F.col("n_words").cast("double"), "mean_word": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "word_chars"), "dup_line_share": lines_per(F.col("n_dup_lines")), "repeat_share": per("n_repeat_words", "n_words"), "upper_share": per("upper", "word_chars"),
        "bang_share": per("bangs", "word_chars"), "bar_share": per("bars", "word_chars"), "digit_share": per("digits", "word_chars"), "mean_line": lines_per(F.col("n_words")), "listed_words": F.col("hits").cast("double"), "listed_share": per("hits", "n_words"),
    }
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.struct(*[features[x].alias(x) for x in FEATURES]).alias("features"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"features.{self.feature}")
        return value >= self.threshold if self.above else value < self.threshold

    def on(self, x: np.ndarray) -> np.ndarray:
        value = x[:, FEATURES.index(self.feature)]
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


def _covers(rule: list[Test], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for test in rule:
        out &= test.on(x)
    return out


def _grow(x: np.ndarray, y: np.ndarray, cuts: int, longest: int) -> list[Test]:
    """Add the test with the largest information gain until no negative is covered."""
    rule: list[Test] = []
    while len(rule) < longest and (p := int(y.sum())) and p < len(y):
        base, best = np.log2(p / len(y)), (1e-9, None)
        for f, name in enumerate(FEATURES):
            values = np.unique(x[:, f])
            if len(values) > cuts:
                values = np.unique(np.quantile(values, np.linspace(0, 1, cuts + 1)))
            for threshold in (values[1:] + values[:-1]) / 2:
                above = x[:, f] >= threshold
                for side, mask in ((True, above), (False, ~above)):
                    if got := int(y[mask].sum()):
                        gain = got * (np.log2(got / int(mask.sum())) - base)
                        if gain > best[0]:
                            best = (gain, Test(name, side, float(threshold)))
        if best[1] is None:
            break
        mask = best[1].on(x)
        rule.append(best[1])
        x, y = x[mask], y[mask]
    return rule


def _value(rule: list[Test], x: np.ndarray, y: np.ndarray) -> float:
    mask = _covers(rule, x)
    p, n = int(y[mask].sum()), int((~y[mask]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, y: np.ndarray, *, precision: float = 0.97, least: int = 3, longest: int = 4, rules: int = 24, cuts: int = 48, seed: int = 5) -> list[list[Test]]:
    """An ordered list of conjunctions for the rows to reject (y true); without any such row, an empty one."""
    order = np.random.default_rng(seed).permutation(len(y))
    x, y, found, failed = x[order], y[order], [], 0
    held = np.arange(len(y)) % 3 == 2
    while len(found) < rules and failed < 3 and y[~held].sum() >= least:
        rule = _grow(x[~held], y[~held], cuts, longest)
        if not rule:
            break
        while len(rule) > 1:  # drop last tests while that does no harm on the pruning rows
            shorter = rule[:-1]
            if _value(shorter, x[held], y[held]) < _value(rule, x[held], y[held]):
                break
            rule = shorter
        mask = _covers(rule, x)
        right = int(y[mask].sum())
        if right >= least and right >= precision * int(mask.sum()):
            found.append(rule)
            x, y, held, failed = x[~mask], y[~mask], held[~mask], 0
        else:  # deal the rows anew
            failed += 1
            held = np.random.default_rng(seed + failed).permutation(len(y)) % 3 == 2
    return found


def expression(rules: list[list[Test]]) -> Column:
    """The verdict of a decision list, true for documents to keep: ordered conditions, then the default."""
    out: Column | None = None
    for rule in rules:
        condition = rule[0].column()
        for test in rule[1:]:
            condition = condition & test.column()
        out = F.when(condition, False) if out is None else out.when(condition, False)
    return F.lit(True) if out is None else out.otherwise(True)


@dataclass(frozen=True)
class Quality:
    """A learned list and the words it counts."""

    listed: list[str]
    rules: list[list[Test]]

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) or "keep all"


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, listed: int = 64, doc_id: str = "doc_id", text: str = "text") -> Quality:
    """Learn from at most `sample` labelled documents (those with the smallest hashes of their id).

    A document is to be rejected if its quality is 0 or toxic is 1; rows of `labels` with a null count as labelled by
    the other column. The counted words are the `listed` best of those that mark toxic documents: in at least 3 of them and
    in 20 times as large a share of them as of the others. Without labels nothing is learned.
    """
    rows = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").select(F.col("doc_id").alias("labelled"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("bad"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    chosen = rows.where("labelled IS NOT NULL").groupBy("labelled").agg(F.max("bad").alias("bad"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    # At most `sample` rows of three narrow columns: small by construction.
    known = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    # Of rows that share an id one text counts, so that the bound on labels bounds rows.
    known = known.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("bad").alias("bad"), F.first("toxic").alias("toxic"))
    each = F.array_distinct(F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", " ")), " "))
    sizes = known.agg(F.sum(F.col("toxic").cast("int")), F.count("*")).first()
    marks: list[str] = []
    if sizes[0]:
        bad, all_ = sizes[0], sizes[1]
        words = known.select("toxic", F.explode(each).alias("word")).where("word <> ''").groupBy("word").agg(F.sum(F.col("toxic").cast("int")).alias("t"), F.count("*").alias("n"))
        share = F.col("t") / bad
        other = (F.col("n") - F.col("t") + 0.5) / (all_ - bad + 1)
        marks = [r.word for r in words.where((F.col("t") >= 3) & (share >= 20 * other)).orderBy(F.desc("t"), "word").limit(listed).collect()]
    table = measured(known, marks).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("features", (F.col("bad") | F.col("toxic")).alias("y")).collect()
    if not table:
        return Quality([], [])
    x = np.array([[r.features[f] for f in FEATURES] for r in table], float)
    return Quality(marks, learn(x, np.array([r.y for r in table], bool)))


def judged(docs: DataFrame, quality: Quality, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts of `measured`, base_failed and kept for every row; rows that repeat or share an id are judged each by its text."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = measured(docs, quality.listed, doc_id=doc_id, text=text)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & expression(quality.rules)).alias("kept"))


def passing(docs: DataFrame, quality: Quality, *, text: str = "text") -> DataFrame:
    """The rows that `judged` keeps, with all their columns."""
    whole = docs.select(F.struct(*[docs[f"`{x}`"] for x in docs.columns]).alias("row"), docs[f"`{text}`"].alias("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(whole, quality.listed, doc_id="row", text="text").where(~failed & expression(quality.rules)).select("doc_id.*")
