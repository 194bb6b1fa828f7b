"""Quality rules as a short-circuit cascade.

Every rule reads one or two facts of a text. A bounded sample tells what each
rule costs and how much it rejects; rules are then tried in the order of
rejections per second, and a text leaves at the first rule that rejects it.
All rules must pass, so their order changes the work and never the verdict.

Defined cases: null or empty text has no words and is rejected; a text of any
length is read whole; rows are judged one by one, so repeated rows, ties and
null ids get a verdict each; an empty table gives an empty result; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The sample that orders the rules, at most 8 million characters whatever the table's size.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 20_000

# Characters that count as symbols, the ASCII white space, and the words between it.
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
NOT_STARTS = bytes(range(0x80, 0xC0))  # second and later bytes of a UTF-8 character


class Facts:
    """What the rules ask about one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes split at 0x20 and 0x09-0x0D only

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).translate(None, NOT_STARTS))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw.translate(None, NOT_SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a 3-word window found twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        covered = end = 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text that has to go."""

    name: str
    rejects: Callable[[Facts], bool]


BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
# Mean length of a word beyond 2 to 15 characters, a symbol for every fifth
# word, and repeats among more than half of the lines.
OWN_RULES = (
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("symbols", lambda t: 5 * t.n_symbols > t.n_words),
    Rule("duplicate_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
)
RULES = BASE_RULES + OWN_RULES


def measure(texts: Sequence[str | None], rules: Sequence[Rule]) -> dict[str, tuple[float, float]]:
    """Seconds a text and share of rejections of every rule, each on its own."""
    out = {}
    for rule in rules:
        facts = [Facts(t) for t in texts]
        start = time.process_time()
        rejected = sum(rule.rejects(f) for f in facts)
        out[rule.name] = ((time.process_time() - start) / max(1, len(facts)),
                          rejected / max(1, len(facts)))
    return out


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
                sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a sample, the best first.

    The sample is the first ``sample_rows`` texts of at most ``SAMPLE_CHARS``
    characters that Spark comes up with, reading no more partitions than it
    takes; they are measured where the plan is made. Ties keep the given order.
    """
    sample = (docs.select(F.col(text).alias("t"))
              .where(F.coalesce(F.length("t"), F.lit(0)) <= SAMPLE_CHARS).limit(sample_rows))
    found = measure([r.t for r in sample.collect()], rules)
    gain = {name: rejected / max(cost, 1e-9) for name, (cost, rejected) in found.items()}
    return sorted(rules, key=lambda r: -gain[r.name])


def passes(facts: Facts, rules: Sequence[Rule]) -> bool:
    return not any(rule.rejects(facts) for rule in rules)


def verdict(rules: Sequence[Rule]):
    """A column function, text -> boolean: true if no rule rejects the text."""
    rules = list(rules)

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        return pd.Series([passes(Facts(t), rules) for t in texts], dtype=bool)

    return keeps


def filter_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass every rule, all columns kept."""
    return docs.where(verdict(order_rules(docs, rules, text))(F.col(text)))


REPORT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean")


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The base counts of every text and the cascade's verdict."""
    base = list(BASE_RULES)
    own = order_rules(docs, OWN_RULES, text)

    def judge(content: str | None) -> tuple:
        f = Facts(content)
        failed = not passes(f, base)
        return (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words,
                failed, not failed and passes(f, own))

    @F.pandas_udf(REPORT)
    def report(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t) for t in texts],
                            columns=[c.split()[0] for c in REPORT.split(", ")])

    judged = docs.select(F.col(doc_id).alias("doc_id"), report(F.col(text)).alias("q"))
    return judged.select("doc_id", "q.*")
