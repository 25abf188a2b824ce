"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed against it into phrases: the longest
piece that occurs in the labelled text, then the next. Phrases times log2 of one length for all languages, the
longest labelled one, is the cost; a symbol that a language never saw costs a phrase of its own. So less labelled text
can only raise a language's cost. The language with the least wins.

Symbols are the bytes (UTF-8) of lower-cased letters; runs of anything else are one space. So every letter of every
script counts. A text is parsed in pieces of ``PIECE`` symbols, each from the automaton's root, so many pieces
advance together in array steps; all pieces of all of the text count. A symbol that a language never saw ends the
phrase before it, or counts as a phrase itself after another such symbol (``charged``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import buffers, slices, tidy

PIECE = 512
#: The fit's bounds: labelled documents of a language, symbols of them all, and the stretches that a document's share is
#: taken from, spread evenly from its first to its last symbol.
SAMPLE_DOCS, SAMPLE_SYMBOLS, STRETCHES = 64, 32_000, 4
#: Languages a model can hold; the labelled column may not have more values.
MOST_LANGUAGES = 256
#: Share of the difference in bits that counts for the score.
TEMPER = 0.1
SPACE = 32
#: Bytes of text that are judged at a time inside a task, and of these, bytes of which symbols are made at a time.
TEXTS, PART = 1 << 21, 1 << 18


@dataclass(frozen=True)
class Table:
    """An automaton's transitions, each state's row laid over the others where they have none: the target of ``state`` by ``s``
    is ``target[base[state] + s]`` if ``owner`` has the state there. The root is 0 and never a target."""

    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = self.base[state] + symbol
        return np.where(self.owner[at] == state, self.target[at], 0)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    tables: list[Table]
    sizes: list[int]


def automaton(sequence: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of a sequence: every substring, and nothing else, leads from 0. By state, the next by symbol."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in sequence:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in nxt[p]:
            nxt[p][s] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][s]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(s) == q:
                    nxt[p][s] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def charged(states: list[dict[int, int]], width: int = 256) -> list[dict[int, int]]:
    """With one more state, to which symbols without a state lead from 0 and from which all go back: a phrase each."""
    return [{s: states[0].get(s, len(states)) for s in range(width)}, *states[1:], {}]


def laid(states: list[dict[int, int]], width: int = 256) -> Table:
    """The transitions as a table: the fullest rows first, each where it fits behind the last row of as many transitions.

    A search never goes back, so its steps are at most the table's length times the number of different sizes of rows.
    """
    base = np.zeros(len(states), np.int32)
    owner: list[int] = [-1] * (width + 2 * sum(map(len, states)) + 4 * width)
    target = [0] * len(owner)
    taken = [False] * len(owner)
    seek: dict[int, int] = {}  # by size of row, where the least symbol of its last one stands
    for state in sorted(range(len(states)), key=lambda x: (-len(states[x]), x)):
        row = states[state]
        if not row:
            continue
        least, rest = min(row), list(row)
        place = seek.get(len(row), width) - least
        while any(taken[place + s] for s in rest):
            place += 1
            if place + 2 * width >= len(owner):
                more = len(owner)
                owner += [-1] * more
                target += [0] * more
                taken += [False] * more
        base[state], seek[len(row)] = place, place + least
        for s, to in row.items():
            owner[place + s], target[place + s], taken[place + s] = state, to, True
    end = max((i for i, x in enumerate(taken) if x), default=0) + width + 1
    end = max(end, int(base.max(initial=0)) + width)
    return Table(base, np.array(owner[:end], np.int32), np.array(target[:end], np.int32))


def spread(stream: bytes, share: int, stretches: int = STRETCHES) -> bytes:
    """``share`` symbols of a stream in stretches from its beginning to its end; a shorter stream whole."""
    if len(stream) <= share:
        return stream
    size = max(1, share // stretches)
    starts = [i * (len(stream) - size) // max(1, stretches - 1) for i in range(stretches)]
    return bytes([SPACE]).join(stream[x : x + size] for x in starts)


def fit(labelled: DataFrame) -> Model:
    """A model from (doc_id, text, lang): a bounded sample per language.

    Rows without lang or a letter in their text are not used. The sample is ``SAMPLE_DOCS`` rows of a language, in order of their
    ids' hashes, and ``SAMPLE_SYMBOLS`` symbols, shared evenly by these rows; what a short text leaves goes to no other.
    Whole texts are read, and a longer one gives stretches from its first to its last symbol. An empty table gives a model without languages.
    """
    order = Window.partitionBy("lang").orderBy("h", "text")
    chosen = (
        labelled.where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
        .select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "text")
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_DOCS)
        .withColumn("docs", F.count("*").over(Window.partitionBy("lang")))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup()
        for batch in batches:
            data, at = buffers(batch.column("text"))
            parts = []
            for i, share in enumerate(batch.column("docs").to_pylist()):
                sym, _, letter = _streams(data, at[i : i + 2], lookup)
                parts.append(spread(sym.tobytes(), SAMPLE_SYMBOLS // share) if letter[0] else b"")
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(parts, pa.binary())], ["lang", "place", "part"])

    # At most MOST_LANGUAGES samples of about SAMPLE_SYMBOLS bytes come to the driver.
    rows = (
        chosen.select("lang", "place", "docs", "text").mapInArrow(cut, "lang string, place int, part binary").where(F.length("part") > 0)
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("parts")).limit(MOST_LANGUAGES + 1).collect()
    )
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    samples = {r.lang: bytes([SPACE]).join(bytes(x.part) for x in r.parts) for r in sorted(rows)}
    return Model(list(samples), [laid(charged(automaton(list(x)))) for x in samples.values()], [max(2, len(x)) for x in samples.values()])


def _lookup() -> np.ndarray:
    """The lower-cased letter of each code point up to U+FFFF; a space for what isn't a letter."""
    out = np.full(1 << 16, SPACE, np.uint32)
    for c in range(1 << 16):
        if (ch := chr(c)).isalpha():
            out[c] = ord(low) if len(low := ch.lower()) == 1 else c
    return out


def _streams(data: np.ndarray, at: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts one after the other, where each text's begin, and whether it has a letter."""
    raw = data[at[0] : at[-1]]
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at - at[0]]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = lookup[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        low = chr(points[i]).lower()
        letters[i] = (ord(low) if len(low) == 1 else points[i]) if chr(points[i]).isalpha() else SPACE
    space = letters == SPACE
    before = np.concatenate([[True], space[:-1]])
    before[starts[:-1][starts[:-1] < len(letters)]] = True
    keep = ~(space & before)  # of a run of spaces the first stays; none at a text's start
    size = 1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF)
    place = np.concatenate([[0], np.cumsum(np.where(keep, size, 0))])
    letter = np.concatenate([[0], np.cumsum(~space)])
    sym = np.frombuffer(letters[keep].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    return sym, place[starts], np.diff(letter[starts]) > 0


def _symbols(data: np.ndarray, at: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_streams`` of all texts, made of some texts at a time."""
    parts = [_streams(data, at[i : j + 1], lookup) for i, j in slices(at, PART)]
    ends = np.cumsum([len(sym) for sym, _, _ in parts])
    places = [place[:-1] + end - len(sym) for (sym, place, _), end in zip(parts, ends)]
    return np.concatenate([sym for sym, _, _ in parts]), np.concatenate([*places, ends[-1:]]), np.concatenate([letter for _, _, letter in parts])


def phrases(sym: np.ndarray, at: np.ndarray, tables: list[Table]) -> np.ndarray:
    """Number of phrases of each text under each table."""
    n = len(at) - 1
    pieces = -(-np.diff(at) // PIECE)
    owner = np.repeat(np.arange(n), pieces)
    first = np.concatenate([[0], np.cumsum(pieces)])[:-1]
    start = at[:-1][owner] + (np.arange(len(owner)) - first[owner]) * PIECE
    size = np.minimum(PIECE, at[1:][owner] - start)
    order = np.argsort(-size, kind="stable")
    owner, start, size = owner[order], start[order], size[order]
    out = np.zeros((n, len(tables)), np.int64)
    if not len(size):
        return out
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # pieces longer than t
    grid = [sym[start[:a] + t] for t, a in enumerate(active)]
    for k, table in enumerate(tables):
        state, count = np.zeros(len(size), np.int32), np.zeros(len(size), np.int32)
        root = table(np.zeros(256, np.int32), np.arange(256, dtype=np.int32))
        for t in range(int(size[0])):
            a = active[t]
            s = grid[t]
            to = table(state[:a], s)
            miss = to == 0
            count[:a] += miss
            state[:a] = np.where(miss, root[s], to)
        count += state != 0
        out[:, k] = np.bincount(owner, count, n).astype(np.int64)
    return out


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; existing columns of these names are replaced.

    A text that is null or has no letter: ``und``, score 0; so has every text under a model without languages.
    The score is the winner's share of 2 ** -(TEMPER * bits), 0 to 1; of equal languages the one with
    the most labelled text, then the first by name, wins.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "score")
    schema = StructType([*rest.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        lookup = _lookup()
        bits = math.log2(max([256, *m.sizes]))
        order = sorted(range(len(m.sizes)), key=lambda x: (-m.sizes[x], x))
        tables, languages = [m.tables[x] for x in order], np.array([m.languages[x] for x in order], object)
        for batch in batches:
            data, at = buffers(batch.column(text))
            for i, j in slices(at, TEXTS):
                sym, place, letter = _symbols(data, at[i : j + 1], lookup)
                names, scores = np.full(j - i, "und", object), np.zeros(j - i)
                if m.languages:
                    cost = phrases(sym, place, tables) * bits
                    best = cost.argmin(1)
                    share = 1 / np.exp2(-TEMPER * (cost - cost.min(1, keepdims=True))).sum(1)
                    names[letter] = languages[best[letter]]
                    scores[letter] = share[letter]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], [*part.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(tidy(label), schema)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is found, at any score; the columns stay as they are."""
    others = docs.drop("text").columns
    held = docs.select(F.struct(*others).alias("row"), "text")
    return identify(held, model).where(F.col("lang_pred") != "und").select(*((F.col("row").getField(c) if c in others else F.col("text")).alias(c) for c in docs.columns))
