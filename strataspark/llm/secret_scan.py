"""Secret scans by grammar inference.

Base spans come from three fixed patterns. The values that they match in all documents are the labelled credentials; all
of them are pooled by format: which characters its runs hold, and its marks. A
value is written as one symbol a character, which is the character set of its run (a token of hexadecimal digits alone
is one run), so that values of a format share a long chain of states instead of falling apart after a few characters.
What a run has beyond RUN characters is written as the digits of its length, and a token of more than RUNS runs as one
run, so that a value of any length is a short word. For each pool a prefix tree is built and states whose frequencies of
ends and symbols agree by Hoeffding's bound are merged; where all values have one length, an end never merges with what
isn't one, however few the values. That leaves a probabilistic automaton of the format: its order of characters and its
lengths. Starts that more values of a pool share than chance allows, of any length up to HEAD, are kept with their
shares. Probabilities are smoothed by how few values a state has seen (Witten-Bell).

Two more automata are inferred from all other tokens, those of SHORT characters or more and shorter
ones. Those may be unlabelled credentials: a token that a format accepts and that the automaton of all other tokens
explains worse is left out of the background; short plain words and numbers never are, for any language has them.
Every token of every text that is at least as long as the shortest word that a format accepts (never under the 8
characters of a base value), and what is left of one beside a base span, is then scored: it is a span of kind `format` if
some format accepts it, start, characters, order and length, and the best format's log likelihood over the background's,
in bits a symbol, exceeds a threshold, a high quantile of the scores of held-out background tokens and a margin. Spans of
the method never touch base ones, which all stay.

The fit reads all documents once and counts every distinct value and token once: no sample is drawn. Spark keeps them a
row each, by a 64-bit hash, as their first HEAD characters and their words, and counts them by word, by start and by how
well a format explains them; the automata are inferred from these counts. What reaches the driver is a row a word, not a
row a token. Words of the background that under one in FORMS tokens has are counted together, by length, as tokens of one
run are written; where there are such, a token's background is the likelier of its own word and that one. The words of
labelled values are all kept apart, for each may be of a format. The scan covers all rows and whole texts.

Defined results: null text counts as empty, with no spans. Repeated rows are scanned alike. Without labelled values
there are no formats and no spans of the method. An empty table gives no rows. A text of any length is one row's work.
Redaction keeps other columns as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, joined, mapped, stored

#: A word of the background that fewer than one in so many tokens has is counted with others of its length.
FORMS = 20_000
#: Tokens from this length on and shorter ones have backgrounds of their own.
SHORT = 16
#: A run's symbols before its length is written, a token's runs, and the characters that a start may have.
RUN, RUNS, HEAD = 40, 24, 64
#: A start counts if chance would share it so rarely (log2).
RARE = -10.0
ALPHA = 0.05
#: The threshold is this quantile of held-out scores and the margin, or the least.
QUANTILE, MARGIN, LEAST_BITS = 0.98, 0.25, 0.5
UNSEEN = 1e-4
#: What may follow in a token: eleven sets, six marks, ten digits of a length, or its end.
EVENTS = 28
KINDS = ("assign", "access", "hex", "format")
#: The base patterns: fixed values.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
SPANS = "array<struct<kind:string,start:int,stop:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


class Automaton:
    """A probabilistic automaton: by state, symbol -> (next state, log2 probability), the log2 probabilities of an end and of an unseen event, and whether it saw an end."""

    def __init__(self, moves: list[dict[str, tuple[int, float]]], ends: list[float], unseen: list[float], final: list[bool]) -> None:
        self.moves, self.ends, self.unseen, self.final = moves, ends, unseen, final

    def bits(self, symbols: str) -> float:
        at, total = 0, 0.0
        for s in symbols:
            move = self.moves[at].get(s)
            if move is None:
                total += self.unseen[at]
            else:
                at, p = move
                total += p
        return total + self.ends[at]

    def accepts(self, symbols: str) -> bool:
        at = 0
        for s in symbols:
            if s not in self.moves[at]:
                return False
            at = self.moves[at][s][0]
        return self.final[at]


_RUN = re.compile("[A-Za-z0-9]+")
_START = re.compile("[A-Za-z]{2,6}[-_]")
_SETS = (("d", "[0-9]+"), ("l", "[a-z]+"), ("U", "[A-Z]+"), ("c", "[A-Z][a-z]+"), ("x", "[0-9a-f]+"), ("X", "[0-9A-F]+"), ("a", "[0-9a-z]+"), ("A", "[0-9A-Z]+"), ("m", "[A-Za-z]+"), ("M", "[0-9A-Za-z]+"))
_KNOWN = [(name, re.compile(of)) for name, of in _SETS]


def _set(run: str) -> str:
    return next(name for name, of in _KNOWN if of.fullmatch(run))


def _written(each: str) -> str:
    """The word of a token's symbols: runs beyond RUN end in the digits of what they have more, many runs are one."""
    runs = [(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", each)]
    if len(runs) > RUNS:
        runs = [("W", len(each))]
    return "".join(s * n if n <= RUN else f"{s * RUN}{n - RUN}" for s, n in runs)


def symbols(token: str) -> str:
    """The word of a token: a symbol for each character: the character set of its run (d digits, l lower, U upper case, c capitalised, x and X hexadecimal, a and A digits with either case, m both cases, M all); marks stand for themselves.

    The runs of a token that are hexadecimal together, or base64 by its marks, are one.
    """
    held = "".join(_RUN.findall(token))
    if not held:
        return _written(token)
    whole = _set(held)
    if whole in "xX" or (whole == "M" and ("+" in token or token.endswith("="))):
        return _written(re.sub("[A-Za-z0-9+/]" if whole == "M" else "[A-Za-z0-9]", whole, token))
    return _written(_RUN.sub(lambda m: _set(m[0]) * len(m[0]), token))


def pool(word: str) -> str:
    """The format that values are pooled by: the word without its runs' lengths."""
    return re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "", word))


def _plain(word: str) -> bool:
    """Whether the token is words of one case, capitalised words or numbers, alone or joined by marks."""
    return not re.search("[xXaAmMW]", word)


def _own_start(head: str, shared: Iterable[int], n: int) -> str:
    """The longest start of a value that counts, of the numbers of values that share its starts of one character on, and of all."""
    own, bits, of_own = "", 0.0, n
    for i, (c, k) in enumerate(zip(head, shared), 1):
        if k == 1:
            break
        bits += math.log2(10 if c.isdigit() else 26) if c.isalnum() else 0.0
        ways = (math.lgamma(of_own + 1) - math.lgamma(k + 1) - math.lgamma(of_own - k + 1)) / math.log(2)
        if ways - bits * (k - 1) < RARE:
            own, bits, of_own = head[:i], 0.0, k
    return own


def _named(head: str) -> str:
    m = _START.match(head)
    return m[0] if m else ""


def _shares(of: dict[str, int], first_name: str, last_name: str) -> dict[str, float]:
    """The log2 of shares from counts of starts; where no start counts, the name that all values have."""
    n = sum(of.values())
    of = {first_name: n} if list(of) == [""] and first_name == last_name else of
    return {own: math.log2(k / n) for own, k in of.items()}


def starts_of(heads: list[str]) -> dict[str, float]:
    """Starts of values and the log2 of their shares; "" stands for the values without one.

    A start counts if that many of the values with the start before it would go on alike by chance, all digits or all
    letters being as likely, with a probability under RARE (log2); each value has the longest that counts. Where none does,
    all values that begin with the same few letters and a mark have that start.
    """
    shared = Counter(head[:i] for head in heads for i in range(1, len(head) + 1))
    own = Counter(_own_start(head, (shared[head[:i]] for i in range(1, len(head) + 1)), len(heads)) for head in heads)
    named = [_named(head) for head in heads]
    return _shares(own, min(named), max(named))


class Format:
    """A pool's starts with the log2 of their shares, and its automaton, from the values' words."""

    def __init__(self, starts: dict[str, float], words: Iterable[str] | dict[str, int]) -> None:
        self.starts, self.automaton = starts, infer(words)
        self.longest_first = sorted(self.starts, key=len, reverse=True)

    def start(self, token: str) -> str | None:
        return next((s for s in self.longest_first if token.startswith(s)), None)

    def accepts(self, token: str, word: str) -> bool:
        return self.start(token) is not None and self.automaton.accepts(word)

    def bits(self, token: str, word: str) -> float:
        return self.starts[self.start(token)] + self.automaton.bits(word)

    def shortest(self) -> int:
        """The least length of an accepted word."""
        reached, n = {0}, 0
        passed = set(reached)
        while reached and not any(self.automaton.final[q] for q in reached):
            reached = {k for q in reached for k, _ in self.automaton.moves[q].values()} - passed
            passed |= reached
            n += 1
        return n


def infer(words: Iterable[str] | dict[str, int], alpha: float = ALPHA) -> Automaton:
    """Merges a prefix tree's statistically compatible states, red-blue order; words, or how often each occurs."""
    kids: list[dict[str, int]] = [{}]
    seen, ended = [0], [0]
    for w, times in sorted(Counter(words).items()):
        at = 0
        seen[0] += times
        for s in w:
            if s not in kids[at]:
                kids[at][s] = len(kids)
                kids.append({})
                seen.append(0)
                ended.append(0)
            at = kids[at][s]
            seen[at] += times
        ended[at] += times
    passed: list[dict[str, int]] = [{s: seen[k] for s, k in node.items()} for node in kids]
    bound, every = math.sqrt(0.5 * math.log(2 / alpha)), seen[0]

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if not seen[a] or not seen[b]:
                continue
            if differ(ended[a], seen[a], ended[b], seen[b]):
                return False
            if seen[a] == seen[b] == every and {ended[a], ended[b]} == {0, every}:
                return False
            for s in passed[a].keys() | passed[b].keys():
                if differ(passed[a].get(s, 0), seen[a], passed[b].get(s, 0), seen[b]):
                    return False
                if s in kids[a] and s in kids[b]:
                    todo.append((kids[a][s], kids[b][s]))
        return True

    def fold(a: int, b: int) -> None:
        """The tree below b, counts and all, goes into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            seen[a] += seen[b]
            ended[a] += ended[b]
            for s, n in passed[b].items():
                passed[a][s] = passed[a].get(s, 0) + n
            for s, k in kids[b].items():
                if s in kids[a]:
                    todo.append((kids[a][s], k))
                else:
                    kids[a][s] = k

    red, done = [0], {0}
    while True:
        blue = [(r, s, k) for r in red for s, k in sorted(kids[r].items()) if k not in done]
        if not blue:
            break
        r, s, k = max(blue, key=lambda x: (seen[x[2]], -x[2]))
        home = next((q for q in red if compatible(q, k)), None)
        if home is None:
            red.append(k)
            done.add(k)
        else:
            kids[r][s] = home
            fold(home, k)
    name = {q: i for i, q in enumerate(red)}
    kinds = [len(passed[q]) + (ended[q] > 0) for q in red]
    unseen = [math.log2(max(k / (seen[q] + k) / max(1, EVENTS - k) if k else 1 / EVENTS, UNSEEN)) for q, k in zip(red, kinds)]
    moves = [{s: (name[kids[q][s]], math.log2(n / (seen[q] + k))) for s, n in passed[q].items()} for q, k in zip(red, kinds)]
    ends = [math.log2(ended[q] / (seen[q] + k)) if ended[q] else u for q, k, u in zip(red, kinds, unseen)]
    return Automaton(moves, ends, unseen, [ended[q] > 0 for q in red])


#: Tokens that any background holds, so that one of few tokens isn't empty.
ORDINARY = ["internationally", "misunderstandings", "Telecommunications", "characteristically", "1234567890123456", "20240102030405", "www.example.com", "docs.example.com/index.html", "well-known-examples", "snake_case_names", "MAINTENANCE_MODE", "CamelCaseIdentifier"]
ORDINARY_SHORT = ["question", "otherwise", "everything", "Wednesday", "Certainly", "IMPORTANT", "20240102", "123456789", "2024-01-02", "example.com", "well-known", "snake_case", "CamelCase", "192.168.10.20", "and/or/not", "MAX_VALUE"]
#: No base value is shorter, so no format and no background token is.
FLOOR = min(LEAST.values())
_EDGES = "._=+/-"


def _finder(least: int = FLOOR):
    of = "[A-Za-z0-9+/_.=-]"
    assign, run, access, hexa = re.compile(ASSIGN, re.IGNORECASE | re.ASCII), re.compile(f"(?<!{of}){of}{{{min(least, LEAST['access'])},}}"), re.compile(ACCESS), re.compile(HEX)

    def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Base spans as (start, kind's number, end), in order, and tokens of the least length, or what is left of them, beside base spans."""
        base = []
        if ":" in text or "=" in text:
            base += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
        runs = [m.span() for m in run.finditer(text)]  # an access key or hex run of the least length lies in one of these
        for a, b in runs:
            base += [(m.start(), 1, m.end()) for m in access.finditer(text, a, b) if m.end() - m.start() >= LEAST["access"]] if b - a >= LEAST["access"] else []
            base += [(m.start(), 2, m.end()) for m in hexa.finditer(text, a, b) if m.end() - m.start() >= LEAST["hex"]] if b - a >= LEAST["hex"] else []
        base.sort()
        free, i = [], 0
        for a, b in runs:
            while i < len(base) and base[i][2] <= a:
                i += 1
            for s, _, e in base[i:]:
                if s >= b:
                    break
                if a < e:
                    if s - a >= least:
                        free.append((a, s))
                    a = e
            if b - a >= least:
                free.append((a, b))
        return base, free

    return find, assign


class Values:
    """A kind's distinct values, a row each (kind, h, head, word), in the stored table of all."""

    def __init__(self, table: DataFrame, kind: str) -> None:
        self.table, self.rows = table, table.where(F.col("kind") == kind)

    def __len__(self) -> int:
        return self.rows.count()


def _tokens(docs: DataFrame) -> DataFrame:
    """kind, h, head, word of all documents' distinct labelled values, by kind, and background tokens (kind "", short ones "short")."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, assign = _finder()
        short = lru_cache(1 << 16)(symbols)
        for pdf in batches:
            held: dict[str, set[str]] = {kind: set() for kind in (*KINDS[:3], "", "short")}
            for text in pdf["text"]:
                base, free = find(text or "")
                for a, k, b in base:
                    held[KINDS[k]].add(assign.match(text, a, b)[2] if k == 0 else text[a:b])
                for a, b in free:
                    token = text[a:b].strip(_EDGES)
                    if len(token) >= FLOOR:
                        held["" if len(token) >= SHORT else "short"].add(token)
            code = lambda v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big", signed=True)
            yield pd.DataFrame([(kind, code(v), v[:HEAD], short(v) if len(v) < SHORT else symbols(v)) for kind, some in held.items() for v in some], columns=["kind", "h", "head", "word"])

    return bounded(docs.select(F.col("text").cast("string").alias("text"))).mapInPandas(run, "kind string, h long, head string, word string").distinct()


def _labelled(docs: DataFrame) -> dict[str, Values]:
    """All documents' distinct labelled values by kind, and their background tokens."""
    table = stored(_tokens(docs), "tokens")
    return {kind: Values(table, kind) for kind in (*KINDS[:3], "", "short")}


def sketch(value: str) -> tuple[str, str]:
    """What the fit knows of a value: its first characters and its word."""
    return value[:HEAD], symbols(value)


def formats_of(values: list[tuple[str, str]]) -> list[Format]:
    """The formats of distinct values' sketches."""
    pools: dict[str, list[tuple[str, str]]] = {}
    for head, word in sorted(values):
        pools.setdefault(pool(word), []).append((head, word))
    return [Format(starts_of([h for h, _ in own]), [w for _, w in own]) for own in pools.values()]


def _formats(values: DataFrame) -> list[Format]:
    """The same from a table of values: heads' starts are counted, and each value's start is found, where the rows are."""
    alike = F.regexp_replace(F.regexp_replace("word", "[0-9]", ""), r"(.)\1+", "$1")
    values = stored(values.select("head", "word").distinct().withColumn("pool", alike), "values")
    words: dict[str, dict[str, int]] = {}
    for r in values.groupBy("pool", "word").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a word
        words.setdefault(r.pool, {})[r.word] = r.n
    if not words:
        return []
    total = {p: sum(w.values()) for p, w in words.items()}
    each = values.select("*", F.explode(F.sequence(F.lit(1), F.length("head"))).alias("i")).withColumn("start", F.substring("head", F.lit(1), F.col("i")))
    shared = stored(each.groupBy("pool", "start").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "starts")
    ks = joined(each, shared, ("pool", "start"), f"k * 1000 > {sum(total.values())}").groupBy("pool", "head", "word").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "k"))), lambda s: s["k"]).alias("ks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [_own_start(h, () if ks is None else ks, total[p]) for p, h, ks in zip(pdf["pool"], pdf["head"], pdf["ks"])]
            yield pd.DataFrame({"pool": pdf["pool"], "own": own, "named": [_named(h) for h in pdf["head"]]})

    found = values.join(ks, ["pool", "head", "word"], "left").select("pool", "head", "ks").mapInPandas(run, "pool string, own string, named string")
    starts: dict[str, list] = {}
    for r in found.groupBy("pool", "own").agg(F.count(F.lit(1)).alias("n"), F.min("named").alias("a"), F.max("named").alias("b")).collect():  # a row a start
        starts.setdefault(r.pool, []).append(r)
    discard(values, shared)
    of = {p: _shares({r.own: r.n for r in sorted(rows, key=lambda r: r.own)}, min(r.a for r in rows), max(r.b for r in rows)) for p, rows in starts.items()}
    return [Format(of[p], words[p]) for p in sorted(words)]


def _judged(tokens: DataFrame, formats: list[Format]) -> list:
    """kind, word, best, half, n: all tokens of the background by word, by the bits of the likeliest accepting format (null without one) and by half; rare words by length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = [max((f.bits(t, w) for f in formats if f.accepts(t, w)), default=None) for t, w in zip(pdf["head"], pdf["word"])]
            yield pd.DataFrame({"kind": pdf["kind"], "word": pdf["word"], "best": pd.array(best, dtype="Float64"), "half": pdf["h"] & 1})

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(word=[_length_word(w) for w in pdf["word"]])

    schema = "kind string, word string, best double, half long"
    counts = stored(tokens.mapInPandas(run, schema).groupBy("kind", "word", "best", "half").agg(F.count(F.lit(1)).alias("n")), "forms")
    common = counts.groupBy("kind", "word").agg(F.sum("n").alias("all"))
    total = common.groupBy("kind").agg(F.sum("all").alias("total"))
    common = common.join(F.broadcast(total), "kind").select("kind", "word", (F.col("all") * FORMS < F.col("total")).alias("rare"))
    held = counts.join(common, ["kind", "word"])
    rare = held.where("rare").drop("rare").mapInPandas(lengths, schema + ", n long").groupBy("kind", "word", "best", "half").agg(F.sum("n").alias("n"))
    out = held.where("not rare").drop("rare").select("*", F.lit(False).alias("rare")).unionByName(rare.select("*", F.lit(True).alias("rare"))).collect()
    discard(counts)
    return out


def _length_word(word: str) -> str:
    """The word of a token of that length that counts as one run."""
    n = sum(len(m[0]) - len(m[2]) + int(m[2] or 0) for m in re.finditer(r"(\D)\1*(\d*)", word))
    return "W" * n if n <= RUN else f"{'W' * RUN}{n - RUN}"


class Background:
    """An automaton of ordinary tokens; where rare ones are counted by length alone, the likelier of a token's word and its length tells."""

    def __init__(self, words: dict[str, int], rare: bool) -> None:
        self.automaton, self.rare = infer(words), rare

    def bits(self, word: str) -> float:
        own = self.automaton.bits(word)
        return max(own, self.automaton.bits(_length_word(word))) if self.rare else own

    def over(self, best: float | None, word: str) -> float:
        """Bits a symbol that a format's explanation exceeds its own by; minus infinity without one."""
        return -math.inf if best is None else (best - self.bits(word)) / len(word)


def _background(rows: list, ordinary: list[str], words_stay: bool) -> tuple[Background, float]:
    """The background of one half of the tokens and the threshold of the other half's scores; tokens that a format accepts and that the other tokens don't explain are left out, but plain words where they stay."""
    usual, rare = Counter(map(symbols, ordinary)), any(r.rare for r in rows)
    alike = [r.best is not None and not (words_stay and _plain(r.word)) for r in rows]

    def of(some: Iterable) -> dict[str, int]:
        words = Counter(usual)
        for r in some:
            words[r.word] += r.n
        return words

    others = Background(of(r for r, a in zip(rows, alike) if not a), rare)
    kept = [r for r, a in zip(rows, alike) if not a or others.over(r.best, r.word) <= LEAST_BITS]
    back = Background(of(r for r in kept if r.half == 0), rare)
    held = sorted((back.over(r.best, r.word), r.n) for r in kept if r.half == 1)
    place, least = int(QUANTILE * (sum(n for _, n in held) - 1)), LEAST_BITS
    for x, n in held:
        if place < n:
            least = max(least, x + MARGIN)
            break
        place -= n
    return back, least


class Model(NamedTuple):
    """The formats, the backgrounds of long and short tokens with their thresholds in bits a symbol, and the least length of a token."""

    formats: list[Format]
    long: tuple[Background | None, float]
    short: tuple[Background | None, float]
    least: int


def fit(docs: DataFrame) -> Model:
    values = _labelled(docs)
    formats = _formats(values["assign"].rows.union(values["access"].rows).union(values["hex"].rows))
    rows = _judged(values[""].rows.union(values["short"].rows), formats) if formats else []
    discard(values[""].table)
    if not formats:
        return Model(formats, (None, math.inf), (None, math.inf), LEAST["access"])
    of = lambda kind: [r for r in rows if r.kind == kind]
    return Model(formats, _background(of(""), ORDINARY, False), _background(of("short"), ORDINARY_SHORT, True), max(FLOOR, min(f.shortest() for f in formats)))


def score(formats: list[Format], back: Background, token: str, word: str) -> float:
    """Bits a symbol that the likeliest accepting format explains the token better than the background does; minus infinity if none accepts it."""
    return back.over(max((f.bits(token, word) for f in formats if f.accepts(token, word)), default=None), word)


def _spotter(model: Model):
    """A function of a text: its spans as (start, kind's number, end), in order of start and kind."""
    find, _ = _finder(model.least)

    @lru_cache(1 << 16)
    def short(token: str) -> bool:
        return score(model.formats, model.short[0], token, symbols(token)) > model.short[1]

    def spot(text: str) -> list[tuple[int, int, int]]:
        spans, free = find(text)
        for a, b in free if model.formats else ():
            token = text[a:b]
            a += len(token) - len(token.lstrip(_EDGES))
            token = token.strip(_EDGES)
            if len(token) >= model.least and (short(token) if len(token) < SHORT else score(model.formats, model.long[0], token, symbols(token)) > model.long[1]):
                spans.append((a, 3, a + len(token)))
        return sorted(spans)

    return spot


def scan(docs: DataFrame, name: str = "spans") -> DataFrame:
    """The columns of the documents, and last, spans under the given name: kind, start and stop (code points) in order of start and kind."""
    model = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = _spotter(model)
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in spot(text or "")] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW_SPANS)], names=[*batch.schema.names, name])

    return bounded(docs).mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{name}` {SPANS}"]))


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, and all spans as text."""
    model = fit(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spot = _spotter(model)
        for pdf in batches:
            said = [[(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in spot(text or "")] for text in pdf["text"]]
            count = lambda kind: [sum(k == kind for k, _ in x) for x in said]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n_assign": count(0), "n_access": count(1), "n_hex": count(2),
                "base_sha256": [hashlib.sha256(",".join(t for k, t in x if k != 3).encode()).hexdigest() for x in said],
                "spans": [",".join(t for _, t in x) for x in said],
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", "doc_id")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by the mark and n_chars counted anew; documents without spans stay as they are."""
    model = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = _spotter(model)
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                spans = spot(text or "")
                if spans:
                    out, at = [], 0
                    for a, _, b in spans:
                        if a >= at:
                            out += [text[at:a], mark]
                        at = max(at, b)
                    text = "".join(out) + text[at:]
                texts.append(text)
            place = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    clean = bounded(docs).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))) if "n_chars" in docs.columns else clean
