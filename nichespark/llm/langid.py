"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample that a model is fitted on, for each language: characters of labelled text,
#: and the longest document that is taken into it (always whole).
SAMPLE_CHARS, SAMPLE_DOC_CHARS = 40_000, 4_096
#: Texts are parsed in pieces of this length, side by side, and then joined (see Parser).
PIECE = 1024
#: States that are remembered at once, of all languages and pieces.
REMEMBERED = 1 << 22
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """Suffix automata of all languages (sorted) in one packed table.

    symbols: the letters of the samples as code points, the most frequent first; their classes are 2 and
    up, 0 is any other letter, 1 all that is no letter. A state s has a step with class c if
    check[base[s] + c] is s, to the state target[base[s] + c]. roots: each language's first state; first: the
    state after each class from there, and 1 where the language has no such class; lengths: of the samples.
    """

    symbols: np.ndarray
    languages: list[str]
    base: np.ndarray
    check: np.ndarray
    target: np.ndarray
    roots: np.ndarray
    first: np.ndarray
    lengths: np.ndarray


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The smallest automaton whose paths from state 0 are the substrings of text: the steps of each state."""
    moves: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def pack(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, target: rows of a sparse table laid over each other, so that no two steps share a place.

    Rows of several steps go to the first places that fit, from where the last one went on; then
    each row of one step fills a gap.
    """
    order = sorted((s for s, m in enumerate(moves) if len(m) > 1), key=lambda s: -len(moves[s]))
    taken, cursor, bases = bytearray(width + 4 * sum(map(len, moves)) + 1), width, {}
    for s in order:
        keys = sorted(moves[s])
        low, rest = keys[0], keys[1:]
        at, tries = cursor, 0
        while taken[at] or any(taken[at + k - low] for k in rest):
            at = taken.find(b"\0", at + 1)
            if (tries := tries + 1) == 12:  # the beginning is full: go on further behind; single steps fill the gaps
                cursor = at
            if at + width >= len(taken):
                taken.extend(bytes(len(taken)))
        bases[s] = at - low
        for k in keys:
            taken[at + k - low] = 1
    single = [(s, *next(iter(m.items()))) for s, m in enumerate(moves) if len(m) == 1]
    free = np.flatnonzero(np.frombuffer(taken, np.uint8)[width:] == 0) + width
    if len(free) < len(single):
        free = np.append(free, len(taken) + np.arange(len(single) - len(free)))
    base = np.zeros(len(moves), np.int64)
    base[list(bases)] = list(bases.values())
    rows = [(s, c, t, bases[s] + c) for s in bases for c, t in moves[s].items()] + [(s, c, t, int(f)) for (s, c, t), f in zip(single, free, strict=False)]
    state, symbol, to, place = np.array(rows, np.int64).reshape(-1, 4).T
    base[state] = place - symbol
    size = int(place.max(initial=0)) + width + 1
    check, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    check[place], target[place] = state, to
    return base.astype(np.int32), check, target


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def class_table(symbols: np.ndarray) -> np.ndarray:
    """The class of every code point: 0 any other letter, 1 what is no letter, 2 and up the symbols."""
    table = np.where(_letters(), 0, 1).astype(np.int32)
    table[symbols] = np.arange(len(symbols)) + 2
    return table


def classes(text: str, table: np.ndarray) -> np.ndarray:
    """The classes of the lower-cased text; a run of characters that are no letters counts as one."""
    c = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    return c[np.concatenate([[True], (c[1:] != 1) | (c[:-1] != 1)])] if len(c) else c


def train(samples: dict[str, list[str]]) -> Model:
    """A model of texts by language. Every letter of the samples is told apart, whatever its script."""
    languages = sorted(samples)
    joined = ["\n".join(samples[x]).lower() for x in languages]
    points, counts = np.unique(np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    letters = _letters()[points]
    points, counts = points[letters], counts[letters]
    symbols = points[np.lexsort((points, -counts))]
    table, width = class_table(symbols), len(symbols) + 2
    moves, roots, lengths = [], [], []
    for text in joined:
        own, at = classes(text, table).tolist(), len(moves)
        moves += [{c: t + at for c, t in m.items()} for m in suffix_automaton(own)]
        roots.append(at)
        lengths.append(len(own))
    first = np.array([[2 * moves[r].get(c, r) + (c not in moves[r]) for c in range(width)] for r in roots], np.int32).reshape(len(roots), width)
    return Model(symbols, languages, *pack(moves, width), np.array(roots, np.int32), first, np.array(lengths, np.int64))


class Parser:
    """Greedy cross-parsing of whole texts against all languages in lockstep.

    A text is cut into pieces that are parsed side by side, each as if a phrase began with it, and the
    states on the way are remembered. Then each piece is entered once more with the state in which the
    piece before it ended, until both ways are in the same state: from there on they are one. A piece
    in which they never meet ends in another state, and the next one is entered again. So phrases cross
    the borders of pieces, and the counts are those of a parse from the beginning to the end.
    """

    def __init__(self, model: Model):
        self.model, self.classes = model, class_table(model.symbols)
        self.flat = model.first.ravel()
        self.row = (np.arange(len(model.roots), dtype=np.int64) * model.first.shape[1])[:, None]
        self.roots = model.roots[:, None]
        self.bits = np.log2(np.maximum(model.lengths, 2).astype(float))

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the phrases that end with the step: one where a step leads nowhere (the next phrase
        begins with its symbol), one more for a symbol that the language has not."""
        m = self.model
        place = m.base[state] + symbol
        again = m.check[place] != state
        from_root = self.flat[self.row + symbol]
        ended = again & (state != self.roots)
        return np.where(again, from_root >> 1, m.target[place]), ended.view(np.int8) + (again & (from_root & 1).astype(bool)).view(np.int8)

    def _block(self, pieces: list[np.ndarray], joined: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each piece by language, and the state after the last piece.

        joined: whether a piece goes on from the one before it (the first one: from the state entry).
        """
        lens = np.array([len(p) for p in pieces])
        order = np.argsort(-lens, kind="stable")
        steps, n, k = int(lens.max()), len(pieces), len(self.roots)
        grid = np.zeros((steps, n), np.int32)
        for lane, p in enumerate(order.tolist()):
            grid[: lens[p], lane] = pieces[p]
        lens, lane_of = lens[order], np.argsort(order)
        states, sums = np.zeros((steps, k, n), np.int32), np.zeros((steps, k, n), np.int16)
        live = np.searchsorted(-lens, -np.arange(1, steps + 1), side="right")
        state, count = np.repeat(self.roots, n, axis=1), np.zeros((k, n), np.int64)
        for t in range(steps):
            on = slice(0, int(live[t]))
            state[:, on], ended = self._step(state[:, on], grid[t, on])
            count[:, on] += ended
            states[t], sums[t] = state, count
        # pairs of language and piece that are entered again
        todo = np.flatnonzero(joined)
        lang, piece = np.repeat(np.arange(k), len(todo)), np.tile(todo, k)
        ends = state.copy()
        while len(piece):
            before = np.where(piece > 0, lane_of[piece - 1], 0)
            now, lane = np.where(piece > 0, ends[lang, before], entry[lang]), lane_of[piece]
            late, at = np.zeros(len(piece), np.int64), np.arange(len(piece))
            changed = []
            for t in range(steps):
                if not len(at):
                    break
                g, ln = lang[at], lane[at]
                place = self.model.base[now[at]] + grid[t, ln]
                again = self.model.check[place] != now[at]
                from_root = self.model.first[g, grid[t, ln]]
                late[at] += (again & (now[at] != self.roots[g, 0])).astype(np.int64) + (again & (from_root & 1).astype(bool))
                now[at] = np.where(again, from_root >> 1, self.model.target[place])
                met, over = now[at] == states[t, g, ln], lens[ln] == t + 1
                hit = at[met | over]
                if len(hit):
                    g, ln = lang[hit], lane[hit]
                    last = lens[ln] - 1
                    count[g, ln] = late[hit] + sums[last, g, ln] - sums[t, g, ln]
                    end = np.where(now[hit] == states[t, g, ln], states[last, g, ln], now[hit])
                    other = end != ends[g, ln]
                    ends[g, ln] = end
                    changed.append(hit[other])
                    at = at[~(met | over)]
            # pieces behind one that now ends in another state
            moved = np.concatenate(changed) if changed else np.zeros(0, np.int64)
            lang, piece = lang[moved], piece[moved] + 1
            goes_on = piece < n
            lang, piece = lang[goes_on], piece[goes_on]
            goes_on = joined[piece]
            lang, piece = lang[goes_on], piece[goes_on]
        return count[:, lane_of].T, ends[:, lane_of]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text for each language, and the characters of each text."""
        coded = [classes(t, self.classes) for t in texts]
        chars = np.array([len(c) for c in coded], np.int64)
        out, k = np.zeros((len(texts), len(self.roots)), np.int64), len(self.roots)
        # texts of about one length stand together; a text's pieces follow each other
        cut = [(i, at) for i in np.argsort(chars, kind="stable").tolist() for at in range(0, len(coded[i]), PIECE)]
        step = max(16, REMEMBERED // (PIECE * k))
        entry = self.roots[:, 0].copy()
        for lo in range(0, len(cut), step):
            part = cut[lo : lo + step]
            joined = np.array([at > 0 for _, at in part])
            counts, ends = self._block([coded[i][at : at + PIECE] for i, at in part], joined, entry)
            np.add.at(out, np.array([i for i, _ in part]), counts)
            # a phrase is open at the end of a text unless it just ended
            last = np.array([at + PIECE >= len(coded[i]) for i, at in part])
            np.add.at(out, np.array([i for i, _ in part])[last], (ends != self.roots).T[last].astype(np.int64))
            entry = ends[:, -1]
        return out, chars

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        fit = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not fit or not len(self.roots):
            return lang, score
        counts, chars = self.phrases([texts[i] for i in fit])
        rate = counts * self.bits[None, :] / np.maximum(chars, 1)[:, None]
        best = rate.argmin(axis=1)
        share = (1 / rate[np.arange(len(fit)), best]) / (1 / rate).sum(axis=1)
        for i, b, s in zip(fit, best.tolist(), share.tolist(), strict=True):
            lang[i], score[i] = self.model.languages[b], float(s)
        return lang, score


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS, seed: int = 3) -> Model:
    """A model of labelled rows (null or empty texts and null labels take no part).

    It is fitted on a bounded sample: per language whole documents of at most SAMPLE_DOC_CHARS
    characters, drawn by a hash of the text until sample_chars are reached. A language with fewer
    characters in such documents takes longer ones too, drawn alike: whole, but of one longer than
    sample_chars the first sample_chars characters. Documents are counted by language first, so that
    the driver gets a few times sample_chars for each language, whatever the input. Copies of a
    text count once. The document with the least hash is always drawn, so every label with a text that
    isn't empty is learned. Without labelled rows the model knows no language.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    drawn = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    rows = rows.withColumns({"n": F.length("text"), "draw": drawn}).where("n > 0").withColumn("long", F.col("n") > SAMPLE_DOC_CHARS)
    held_of = F.least("n", F.lit(max(sample_chars, SAMPLE_DOC_CHARS)))
    counted = rows.select("lang", "long", "draw", held_of.alias("n")).distinct()
    sizes = {(r["lang"], r["long"]): r for r in counted.groupBy("lang", "long").agg(F.sum("n").alias("chars"), F.min("draw").alias("least")).collect()}
    if not sizes:
        return train({})
    limits = []
    for (lang, long), r in sizes.items():
        short = sizes.get((lang, False))
        if long and short and short["chars"] >= sample_chars:
            continue
        limits.append((lang, long, max(r["least"], min(1.0, (3.0 * sample_chars + 3 * SAMPLE_DOC_CHARS) / r["chars"]))))
    part = {x: F.create_map(*[F.lit(y) for lang, long, limit in limits if long == x for y in (lang, limit)]) for x in {long for _, long, _ in limits}}
    taken = F.lit(False)
    for x, limit in part.items():
        taken = taken | ((F.col("long") == x) & F.coalesce(F.col("draw") <= F.try_element_at(limit, F.col("lang")), F.lit(False)))
    found = rows.where(taken).select("lang", "long", "draw", F.substring("text", 1, max(sample_chars, SAMPLE_DOC_CHARS)).alias("text")).distinct().collect()
    samples: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["long"], r["draw"], r["text"])):
        if held.get(r["lang"], 0) < sample_chars:
            samples.setdefault(r["lang"], []).append(r["text"])
            held[r["lang"]] = held.get(r["lang"], 0) + len(r["text"])
    return train(samples)


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (or other names).

    The whole text is lower-cased, runs of other characters than letters become one separator, and it is cut into phrases, each the longest that occurs in a
    language's sample; the language with the fewest phrases, normalised by log2 of the sample's length and the
    text's length, wins (ties: the first by code points). score is the share of 1 / rate that
    the winner has among all languages. Null texts and texts without a letter are `und` with
    score 0, as is everything under a model without languages. Only the text decides. Columns
    of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(*names)
    at = rows.columns.index(text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                lang, score = parser.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, *names])

    return rows.mapInArrow(run, f"{kinds}, `{names[0]}` string, `{names[1]}` double")
