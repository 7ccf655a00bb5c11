"""Quality rules as a learned decision list, in DataFrame expressions only.

Statistics of a text are built-in expressions over its words and lines. Sequential covering learns rules from labelled
statistics: a rule grows by the threshold condition that gains most on one part of the labelled rows, is pruned on the
other part, and is kept if it is precise there; the rows that it covers leave, until no good rule is left. The list becomes
one conditional expression, whose first fitting rule decides.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import durable

from .common import lowest_keys

#: What separates words, and the characters that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), f), 0)


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows that occur twice or more: windows are sorted by hash, and the union of the repeated ones is summed."""

    def covered(sorted_windows: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(sorted_windows, a)["h"] == F.get(sorted_windows, b)["h"], F.lit(False))
        places = F.filter(F.sequence(F.lit(0), F.size(sorted_windows) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        starts = F.sort_array(F.transform(places, lambda k: F.get(sorted_windows, k)["i"]))
        first = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("sum"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(window), p - acc["last"])).alias("sum"))
        return _bind(starts, lambda s: F.aggregate(s, first, step, lambda acc: acc["sum"]))

    hashed = F.transform(
        F.sequence(F.lit(0), F.size(words) - window),
        lambda i: F.struct(F.xxhash64(*(F.get(words, i + j) for j in range(window))).alias("h"), i.alias("i")),
    )
    return F.when(F.size(words) > window, _bind(F.sort_array(hashed), covered)).otherwise(0)


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and statistics of each whole text; a null text has no words and no lines. Repeated rows each come back.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (in 3-word windows found twice or more;
    windows are compared by a 64-bit hash), ``n_lines`` (with a word) and ``n_distinct`` words, all bigint.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACES))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    by_word = _bind(
        words,
        lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w, 3).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct")),
    )
    by_line = _bind(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    rows = df.select(
        F.col(f"`{key}`").alias("__key"), by_word.alias("w"), by_line.alias("l"),
        F.length(F.translate(whole, SPACES, "")).alias("word_chars"), (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).alias("n_symbols"),
    )
    made = ["w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "w.n_distinct"]
    return rows.select(F.col("__key").alias(key), *(F.col(n).cast("bigint").alias(n.split(".")[-1]) for n in made))


def ratios() -> dict[str, Column]:
    """What the rules look at: counts and shares of the statistics; a share of nothing is 0."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``name`` at least ``bound`` (``above``), or below it."""

    name: str
    above: bool
    bound: float

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.name] >= self.bound) == self.above

    def column(self, columns: dict[str, Column]) -> Column:
        one = columns[self.name]
        return one >= F.lit(self.bound) if self.above else one < F.lit(self.bound)


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _split(rows: list[dict]) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def _grow(rows: list[dict], names: list[str], thresholds: dict[str, list[float]], most: int) -> Rule:
    """Adds the condition of the largest information gain until no good row is covered."""
    rule: Rule = ()
    while len(rule) < most:
        p, n = _split(rows)
        if not n or not p:
            break
        before, best = math.log2(p / (p + n)), (0.0, None)
        for name in names:
            order = sorted((r[name], r["bad"]) for r in rows)
            at, seen_p, seen = 0, 0, 0
            for bound in thresholds[name]:
                while at < len(order) and order[at][0] < bound:
                    seen_p, seen, at = seen_p + order[at][1], seen + 1, at + 1
                for above, q, total in ((False, seen_p, seen), (True, p - seen_p, p + n - seen)):
                    if q:
                        gain = q * (math.log2(q / total) - before)
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(name, above, bound))
        if best[1] is None:
            break
        rule += (best[1],)
        rows = _covered(rule[-1:], rows)
    return rule


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """The beginning of the rule with the best balance of covered bad over good rows; the shorter one of equals."""

    def worth(r: Rule) -> float:
        p, n = _split(_covered(r, rows))
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=rule)


def learn(rows: list[dict[str, float]], names: list[str], most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, least: int = 5, cuts: int = 64) -> list[Rule]:
    """Decision list for bad rows (``bad`` is 1) by sequential covering; every third row prunes, the others grow.

    A rule is kept if at least ``least`` bad rows and a share of ``precision`` of the rows it covers are bad, over all rows
    and over those that prune; otherwise learning ends. No bad or no good row gives an empty list.
    """
    rules: list[Rule] = []
    rest = list(rows)
    values = {n: sorted({r[n] for r in rows}) for n in names}
    thresholds = {n: sorted({v[len(v) * i // cuts] for i in range(1, cuts)} | set(v[1:4])) if len(v) > cuts else v[1:] for n, v in values.items()}
    while len(rules) < most_rules:
        rule = _grow([r for i, r in enumerate(rest) if i % 3], names, thresholds, most_conditions)
        rule = _prune(rule, rest[::3]) if rule else rule
        p, n = _split(_covered(rule, rest))
        held_p, held_n = _split(_covered(rule, rest[::3]))
        if not rule or p < least or p < precision * (p + n) or held_p < precision * (held_p + held_n):
            break
        rules.append(rule)
        rest = [r for r in rest if not all(c.holds(r) for c in rule)]
    return rules


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 20_000, **learning) -> list[Rule]:
    """Rules for texts whose label is 0, from at most ``most`` labelled rows (by a hash of the key, from all labelled rows).

    Rows with a null key or label teach nothing; without labelled rows of both kinds there is no rule.
    """
    known = labels.select(F.col(key).alias("__id"), F.col(label).cast("int").alias("label")).where("__id is not null and label is not null").dropDuplicates(["__id"])
    keys = lowest_keys(known, "__id", most, known.count())
    chosen = F.broadcast(known.join(F.broadcast(keys), "__id"))  # at most ``most`` rows
    texts = df.join(chosen, F.col(key) == F.col("__id")).select("__id", "label", F.col(text).alias("__text"))
    made = statistics(texts.select(F.struct("__id", "label").alias("k"), "__text"), "k", "__text")
    rows = durable(made).where(~base_failed()).select("k.__id", F.when(F.col("k.label") == 0, 1).otherwise(0).alias("bad"), *(c.alias(n) for n, c in ratios().items()))
    found = [r.asDict() for r in rows.collect()]  # at most ``most`` rows of a few numbers
    found.sort(key=lambda r: (hash_of(r["__id"]), str(r["__id"])))
    return learn(found, list(ratios()), **learning)


def hash_of(key) -> int:
    return zlib.crc32(str(key).encode())


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Number of the first rule that fits (from 1, null if none does), and whether the text is kept."""
    columns = ratios()
    which, kept = F.lit(None).cast("int"), F.lit(True)
    for number, rule in reversed(list(enumerate(rules, 1))):
        fits = rule[0].column(columns)
        for c in rule[1:]:
            fits = fits & c.column(columns)
        which, kept = F.when(fits, F.lit(number)).otherwise(which), F.when(fits, F.lit(False)).otherwise(kept)
    return which, kept


def judge(df: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics with ``base_failed``, ``kept`` and ``rule``: not kept where the base fails, else as the list decides."""
    which, kept = verdict(rules)
    rows = statistics(df, key, text).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & kept).withColumn("rule", F.when(~F.col("base_failed"), which))
