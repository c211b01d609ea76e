"""Problem 6: free-entered values mapped to the entries of a canonical list.

Method: a multi-pattern automaton over canonical names and aliases finds embedded mentions, the longest
non-overlapping match wins, and what is left goes to token-set similarity, with spelled-together,
abbreviated and cut-off writings tried before it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.cells import entered_values
from corpusmill.operators.skew import hot_threshold, salted_lookup
from corpusmill.session import cut_lineage
from corpusmill.sources.tables import table

FIELD_KIND = {"concepts": "concept", "tags": "tag", "risk_category": "risk_category"}
SIMILAR = 0.78
COVERED = 0.5
#: Distinct values that a task takes.
TASK_VALUES = 500
#: Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKE = str.maketrans("абвгеёіјкмнорсѕтухһԁԛԝАВЕЗІЈКМНОРСЅТУХԌαβεηικνορτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aбbгeeijkmнopcstyxhdqwABE3IJKMHOPCSTYXGaβenikvoptuxwABEZHIKMNOPTYX")
_JOINERS = {"of", "the", "and", "in", "for", "to", "a"}


def edit_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between a and b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def likeness(a: str, b: str, least: float) -> float:
    """1 - edit distance / longer length; 0 if that is below least."""
    n = max(len(a), len(b))
    most = int(n * (1 - least) + 1e-9)
    d = edit_distance(a, b, most)
    return 1 - d / n if n and d <= most else 0.0


def words_of(value: str) -> list[str]:
    """Words in lower case: compatibility forms, look-alike letters, joined capitals and decorations resolved."""
    s = "".join(ch for ch in unicodedata.normalize("NFKC", value) if unicodedata.category(ch) != "Cf")
    s = s.translate(_LOOKALIKE)
    s = re.sub(r"^\s*(?:re|fwd?|see|cf|aw)\s*[:.]\s+", "", s, flags=re.I)
    s = re.sub(r"\((?:[^()]*)\)\s*$", "", s) or s
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", s) if not s.isupper() and re.match(r"\W*[A-Z]", s) and " " not in s.strip() else s
    return re.findall(r"[^\W_]+", s.casefold())


class Matcher:
    """The names of one kind: match(value) gives the name a value is a writing of, or the empty string."""

    def __init__(self, entries: list[tuple[str, list[str]]]):
        self.forms: dict[str, str] = {}
        for name, aliases in entries:
            self.forms.setdefault(" ".join(words_of(name)), name)
        for name, aliases in entries:
            for alias in aliases or []:
                self.forms.setdefault(" ".join(words_of(alias)), name)
        self.forms.pop("", None)
        self.squashed: dict[str, str] = {}
        for form, name in self.forms.items():
            self.squashed.setdefault(form.replace(" ", ""), name)
        self.automaton = ahocorasick.Automaton()
        for form in self.forms:
            self.automaton.add_word(f" {form} ", form)
        if self.forms:
            self.automaton.make_automaton()
        short: dict[str, set[str]] = defaultdict(set)
        for name, _ in entries:
            words = words_of(name)
            spaced = words_of(name.replace("-", ""))
            for w in (words, spaced, [x for x in words if x not in _JOINERS], [x for x in spaced if x not in _JOINERS]):
                if len(w) > 1:
                    short["".join(x[0] for x in w)].add(name)
        self.short = {k: v.pop() for k, v in short.items() if len(v) == 1}
        self.names = [" ".join(words_of(name)) for name, _ in entries]
        self.listed = list(self.forms)
        grams = [Counter(self._grams(form)) for form in self.listed]
        self.n_grams = [sum(g.values()) for g in grams]
        self.holders: dict[str, list[tuple[int, int]]] = defaultdict(list)  # pair of letters -> forms with it, and how often
        for i, g in enumerate(grams):
            for pair, times in g.items():
                self.holders[pair].append((i, times))

    @staticmethod
    def _grams(text: str) -> list[str]:
        t = text.replace(" ", "")
        return [t[i : i + 2] for i in range(len(t) - 1)]

    def embedded(self, words: list[str]) -> str:
        """The longest mention; mentions that overlap a longer one don't count, and it must make up half of the value."""
        text = f" {' '.join(words)} "
        spans = [(end - len(form) - 1, end, form) for end, form in self.automaton.iter(text)] if self.forms else []
        if not spans:
            return ""
        start, _, form = max(spans, key=lambda s: (len(s[2]), -s[0]))
        return self.forms[form] if len(form.replace(" ", "")) >= COVERED * sum(map(len, words)) else ""

    def cut_off(self, value: str, words: list[str]) -> str:
        """The only name that begins as the value does; without a mark of omission the value needs four letters."""
        marked = bool(re.search(r"(?:\.|…)\s*$", value))
        start = " ".join(words)
        if len(start.replace(" ", "")) < (3 if marked else 4):
            return ""
        for forms in (self.names, list(self.forms)):
            found = {self.forms[f] for f in forms if f in self.forms and f.startswith(start)}
            if len(found) == 1:
                return found.pop()
        return ""

    def similar(self, words: list[str]) -> str:
        """The name most similar as a whole or word by word in any order; none below SIMILAR or if two names tie."""
        text = " ".join(words)
        grams = Counter(self._grams(text))
        n, shared = sum(grams.values()), defaultdict(int)
        for pair, times in grams.items():
            for i, other in self.holders.get(pair, ()):
                shared[i] += min(times, other)
        best: dict[str, float] = {}
        for i in sorted(shared):  # a form without a common pair of letters can't be similar
            if shared[i] * 2 < 0.2 * (n + self.n_grams[i]):
                continue
            form = self.listed[i]
            name = self.forms[form]
            score = max(likeness(text.replace(" ", ""), form.replace(" ", ""), SIMILAR), self._word_likeness(words, form.split()))
            if score >= SIMILAR and score > best.get(name, 0):
                best[name] = score
        if not best:
            return ""
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))
        return top[0][0] if len(top) == 1 or top[0][1] - top[1][1] > 1e-9 else ""

    @staticmethod
    def _word_likeness(a: list[str], b: list[str]) -> float:
        left, total, same = list(b), sum(map(len, a)) + sum(map(len, b)), 0.0
        for w in sorted(a, key=len, reverse=True):
            near = max(((likeness(w, x, 0.6), x) for x in left), default=(0.0, ""))
            if near[0]:
                same += near[0] * (len(w) + len(near[1]))
                left.remove(near[1])
        return same / total if total else 0.0

    def match(self, value: str) -> str:
        words = words_of(value)
        if not words:
            return ""
        if name := self.forms.get(" ".join(words)) or self.embedded(words) or self.squashed.get("".join(words)):
            return name
        letters = re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", value).translate(_LOOKALIKE)).casefold()
        if re.fullmatch(r"\W*(?:\w\W{0,2}){2,7}", value) and letters in self.short:
            return self.short[letters]
        return self.cut_off(value, words) or self.similar(words)


_MATCHERS: dict[str, dict[str, Matcher]] = {}


def _matchers(kinds: dict[str, list[tuple[str, list[str]]]]) -> dict[str, Matcher]:
    """The matchers of a vocabulary, built once per worker process; the last vocabulary's are kept."""
    key = repr(sorted(kinds.items()))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = {k: Matcher(v) for k, v in kinds.items()}
    return _MATCHERS[key]


def canonical_names(entered: DataFrame, vocabulary: DataFrame, values: int | None = None) -> DataFrame:
    """kind, entered, n, name for each distinct value: name is the empty string if the value means no entry.

    entered: kind, entered and n (how many cells hold it). vocabulary: kind, name, triggers; it is a fixed
    list and is carried to the tasks whole. Values of kinds without entries match nothing. values is the number
    of rows of `entered`, if known: work per value is large beside its size, so tasks are cut by number.
    """
    values = entered.count() if values is None else values
    kinds: dict[str, list[tuple[str, list[str]]]] = defaultdict(list)
    for r in vocabulary.where("kind IS NOT NULL AND name IS NOT NULL").select("kind", "name", "triggers").orderBy("kind", "name").collect():
        kinds[r.kind].append((r.name, [t for t in r.triggers or [] if t]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from corpusmill.llm.canonical_values import _matchers as built  # the worker's own module, so that tasks share it

        matchers, none = built(kinds), Matcher([])
        for b in batches:
            b["name"] = [matchers.get(k, none).match(v) for k, v in zip(b["kind"], b["entered"])]
            yield b

    spread = entered.select("kind", "entered", "n").repartition(max(1, -(-values // TASK_VALUES)), "kind", "entered")
    return spread.mapInPandas(run, "kind string, entered string, n bigint, name string")


def mapped_values(sources: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row_id, field, entered, name of each distinct entered value of a row and field that isn't exactly a name of the field's kind.

    Null, blank and placeholder cells have none. Each distinct value is matched once, however many rows hold
    it, and goes back to the rows by a salted join.
    """
    cells = sources.select("row_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), entered_values(F.col(f)).alias("v")) for f, k in FIELD_KIND.items()])).alias("c"))
    values = cells.select("row_id", "c.field", "c.kind", F.explode("c.v").alias("entered"))
    exact = vocabulary.select("kind", F.col("name").alias("entered")).distinct()
    cases = values.join(F.broadcast(exact), ["kind", "entered"], "left_anti")  # the fixed vocabulary
    counted = cut_lineage(cases.groupBy("kind", "entered").agg(F.count("*").alias("n")))
    key = F.concat_ws("\x00", "kind", "entered").alias("k")
    names = cut_lineage(canonical_names(counted, vocabulary).select(key, "n", "name"))  # read twice below, matched once
    found = salted_lookup(cases.select("row_id", "field", "entered", key), names, "k", "n", hot_rows=hot_threshold(sum(r.n for r in names.agg(F.sum("n").alias("n")).where("n > 0").collect())))
    return found.select("row_id", "field", "entered", "name")


def p6_found(spark, sf_dir):
    return mapped_values(table(spark, sf_dir, "notion_sources"), table(spark, sf_dir, "vocab_terms"))


def p6_unmatched(spark, sf_dir):
    """Values that mean no entry, with the number of rows that hold them."""
    return p6_found(spark, sf_dir).where("name = ''").groupBy("field", "entered").agg(F.count("*").alias("n_rows"))


QUERIES = {"p6_found": p6_found, "p6_unmatched": p6_unmatched}
SQL: dict[str, str] = {}
