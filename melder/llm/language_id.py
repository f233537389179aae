"""Language identification by cross-parsing entropy (operator 5).

For each language a suffix automaton of labelled text is built. A text is parsed against it
greedily: a phrase is the longest match from where the last one ended. The fewer phrases, the
closer the text is to the language; counts are normalised by the logarithm of the automaton's
text length. Many texts are parsed at once, one symbol a step, over dense transition tables.

Long texts are parsed in segments at once, each from the root of the automaton; then each segment
is parsed anew from the state in which the one before it ended, until both parses are in the same
state, from where on they agree. The counts are those of one parse of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melder.llm.common import batches_of, crc32_mod, written

#: The learning sample: so many labelled rows of a language at most. Of a longer row, so many code
#: points in WINDOWS spread evenly over it; all rows of a language share the automaton's symbols
#: evenly. With over 16 languages each one's automaton is smaller, so that all fit in a worker.
SAMPLE_ROWS = 48
SAMPLE_CHARS = 20_000
WINDOWS = 16
LEARN_SYMBOLS = 24_000
ALL_SYMBOLS = 400_000
LETTERS = 47  # the most frequent letters are a symbol each; any other is spelled by its code's hexadecimal digits
SEGMENT = 1024  # symbols that are parsed at once
COLUMNS = 2048  # segments that are parsed at once
FOLDS, HELD_OUT = 4, 2
SPACE, DIGITS, FIRST_LETTER, RARE = 0, 1, 17, 255


def _letter(code: int) -> str | None:
    c = chr(code)
    low = c.lower()
    return low if c.isalpha() and len(low) == 1 else c if c.isalpha() else None


def _alphabet(texts: list[str]) -> str:
    """The most frequent letters, in order."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found, n = np.unique(codes, return_counts=True)
    count: dict[str, int] = {}
    for code, k in zip(found.tolist(), n.tolist(), strict=True):
        if letter := _letter(code):
            count[letter] = count.get(letter, 0) + k
    return "".join(sorted(sorted(count), key=lambda c: -count[c])[:LETTERS])


@lru_cache(maxsize=2)
def _symbols(alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point below 2**16, RARE for letters without one and SPACE for all else;
    and the code points of their lower-case letters."""
    table, folded = np.full(1 << 16, SPACE, dtype=np.uint8), np.arange(1 << 16, dtype=np.int64)
    at = {c: i + FIRST_LETTER for i, c in enumerate(alphabet)}
    for code in range(1 << 16):
        if not 0xD800 <= code < 0xE000 and (letter := _letter(code)):
            table[code], folded[code] = at.get(letter, RARE), ord(letter)
    return table, folded


def symbols(text: str, alphabet: str) -> tuple[np.ndarray, bool]:
    """Symbols of a text, runs of non-letters as one SPACE; and whether it has a letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table, folded = _symbols(alphabet)
    low = np.minimum(codes, 0xFFFF)
    out, own = table[low], folded[low]
    for i in np.flatnonzero(codes > 0xFFFF):
        letter = _letter(int(codes[i]))
        out[i], own[i] = (RARE, ord(letter)) if letter else (SPACE, 0)
    blank = out == SPACE
    letters = not blank.all()
    keep = ~(blank & np.append(False, blank[:-1]))
    out, own = out[keep], own[keep]
    rare = out == RARE
    if rare.any():
        # four digits, five beyond the basic plane
        size = np.where(rare, np.where(own > 0xFFFF, 5, 4), 1)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        digit = (np.repeat(own, size) >> (4 * (np.repeat(size, size) - 1 - place))) & 15
        out = np.where(np.repeat(rare, size), DIGITS + digit, np.repeat(out, size)).astype(np.uint8)
    return out, letters


def automaton(text: np.ndarray, size: int) -> np.ndarray:
    """Transitions [state, symbol] of the suffix automaton of a symbol sequence; -1 for none."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nxt), size), -1, dtype=np.int32)
    for state, row in enumerate(nxt):
        for c, to in row.items():
            table[state, c] = to
    return table


def _shares(rows: list[np.ndarray], most: int) -> np.ndarray:
    """At most `most` symbols of the rows, the same number of each as far as they go; of a longer one
    in WINDOWS spread evenly over it."""
    left, out = most, []
    for k, r in enumerate(sorted(rows, key=len)):
        quota = left // (len(rows) - k)
        if len(r) > quota:
            each = max(1, quota // WINDOWS)
            r = np.concatenate([r[i : i + each] for i in np.linspace(0, len(r) - each, quota // each).astype(int)]) if quota else r[:0]
        left -= len(r)
        out += [r, np.array([SPACE], dtype=np.uint8)]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint8)


@lru_cache(maxsize=2)
def _tables(alphabet: str, texts: tuple[tuple[str, tuple[str, ...]], ...], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All languages' transitions flat, each one's first entry, and their normalisers."""
    size = FIRST_LETTER + len(alphabet)
    parts, logs = [], []
    for _, own in texts:
        learned = _shares([symbols(t, alphabet)[0] for t in own], most)
        parts.append(automaton(learned, size))
        logs.append(np.log2(max(len(learned), 2)))
    start = np.cumsum([0, *[p.size for p in parts]])[:-1]
    # a state is kept as the index of its row in the flat table
    flat = np.concatenate([np.where(p < 0, -1, p * size + s).ravel() for p, s in zip(parts, start, strict=True)]).astype(np.int32)
    return flat, start.astype(np.int32), np.array(logs)


def _step(flat: np.ndarray, root: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after a symbol, and how many phrases end with it: one that was open if the symbol
    doesn't go on with it, and the symbol itself if no phrase starts with it. Open is any state but the root."""
    to = flat[state + symbol]
    again = flat[root + symbol]
    alone = again < 0
    ends = ((to < 0) & (state != root)).astype(np.int8) + alone
    return np.where(alone, root, np.where(to < 0, again, to)), ends


def _parsed(cut: list[tuple[int, int, np.ndarray]], flat: np.ndarray, start: np.ndarray, held: np.ndarray, out: np.ndarray) -> None:
    """Adds the phrases of segments (row, number, symbols) to out; held has the state in which each
    row's parse stands before and after."""
    order = sorted(range(len(cut)), key=lambda j: -len(cut[j][2]))
    size = np.array([len(cut[j][2]) for j in order])
    n, langs = len(order), len(start)
    steps = int(size[0]) if n else 0
    grid = np.zeros((steps, n), dtype=np.int32)
    for j, k in enumerate(order):
        grid[: size[j], j] = cut[k][2]
    active = n - np.searchsorted(size[::-1], np.arange(steps), side="right")
    root = np.repeat(start[:, None], n, axis=1)
    state = root.copy()
    states = np.zeros((steps, langs, n), dtype=np.int32)
    ends = np.zeros((steps, langs, n), dtype=np.int8)
    for t in range(steps):
        m = int(active[t])
        state[:, :m], ends[t, :, :m] = _step(flat, root[:, :m], state[:, :m], grid[t, :m])
        states[t, :, :m] = state[:, :m]
    place = {(cut[k][0], cut[k][1]): j for j, k in enumerate(order)}
    row = np.array([cut[k][0] for k in order])
    before = np.array([place.get((cut[k][0], cut[k][1] - 1), -1) for k in order])
    used = root.copy()
    while True:
        entry = np.where(before >= 0, state[:, before], held[row].T)
        lang, col = np.nonzero(entry != used)
        if not len(lang):
            break
        used = entry
        now = entry[lang, col]
        for t in range(steps):
            going = t < size[col]
            lang, col, now = lang[going], col[going], now[going]
            if not len(lang):
                break
            now, ends[t, lang, col] = _step(flat, start[lang], now, grid[t, col])
            met = states[t, lang, col] == now
            states[t, lang, col] = now
            last = ~met & (t + 1 == size[col])
            state[lang[last], col[last]] = now[last]
            lang, col, now = lang[~met], col[~met], now[~met]
    np.add.at(out, row, ends.sum(axis=0, dtype=np.int64).T)
    final = {r: j for (r, _), j in sorted(place.items())}
    held[list(final)] = state[:, list(final.values())].T


def phrases(rows: list[np.ndarray], flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """[row, language]: phrases in the parse of each row of symbols."""
    cut = [(i, k // SEGMENT, r[k : k + SEGMENT]) for i, r in enumerate(rows) for k in range(0, len(r), SEGMENT)]
    out = np.zeros((len(rows), len(start)), dtype=np.int64)
    held = np.repeat(start[None, :], len(rows), axis=0)
    for k in range(0, len(cut), COLUMNS):
        _parsed(cut[k : k + COLUMNS], flat, start, held, out)
    return out + (held != start[None, :])  # the phrase that is open at the end


class Model:
    """Languages with their learning texts; tables are built once in each Python worker."""

    def __init__(self, texts: dict[str, list[str]]):
        self.texts = tuple((k, tuple(v)) for k, v in sorted(texts.items()))
        self.alphabet = _alphabet([t for _, own in self.texts for t in own])
        self.most = min(LEARN_SYMBOLS, ALL_SYMBOLS // max(1, len(texts)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score: the runner-up's share of both phrase counts, so 0.5 for a tie and
        1 without a runner-up; `und` and 0 for texts without a letter or if nothing was learned."""
        und = ["und"] * len(texts), [0.0] * len(texts)
        if not self.texts:
            return und
        flat, start, logs = _tables(self.alphabet, self.texts, self.most)
        made = [symbols(t or "", self.alphabet) for t in texts]
        cost = phrases([s if ok else s[:0] for s, ok in made], flat, start) * logs[None, :]
        order = np.argsort(cost, axis=1, kind="stable")
        at = np.arange(len(texts))
        best = cost[at, order[:, 0]]
        score = cost[at, order[:, 1]] / np.maximum(cost[at, order[:, 1]] + best, 1e-12) if len(start) > 1 else np.ones(len(texts))
        lang, out = und
        for i, (_, ok) in enumerate(made):
            if ok:
                lang[i], out[i] = self.texts[order[i, 0]][0], float(min(1.0, max(0.0, score[i])))
        return lang, out


def learn(labelled: DataFrame) -> Model:
    """From labelled(doc_id, text, lang): at most SAMPLE_ROWS rows of each language, drawn by a hash
    of doc_id; of a row over SAMPLE_CHARS code points as many, spread over it. Rows with a null
    lang or text aren't learned from."""
    rows = labelled.where("lang is not null and text is not null")
    n = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = SAMPLE_CHARS // WINDOWS
    spread = f"array_join(transform(sequence(0, {WINDOWS - 1}), k -> substr(text, cast(1 + k * (length(text) - {each}) div {WINDOWS - 1} as int), {each})), ' ')"
    drawn = rows.select("doc_id", "lang", F.expr(f"if(length(text) > {SAMPLE_CHARS}, {spread}, text)").alias("text"), (F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id"), 11) / F.lit(float(1 << 53))).alias("u")).join(n, "lang")
    # twice the rows wanted on average, so that as good as never too few are drawn
    some = drawn.where(F.col("u") * F.col("n") < 2 * SAMPLE_ROWS).orderBy("lang", "u", "doc_id", "text")
    texts: dict[str, list[str]] = {}
    for r in some.select("lang", "text").toLocalIterator():
        own = texts.setdefault(r["lang"], [])
        if len(own) < SAMPLE_ROWS:
            own.append(r["text"])
    return Model(texts)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang).

    Learns from rows whose crc32(doc_id as text) mod 4 is not 2; predicts all from whole texts.
    Null texts and texts without a letter are `und`. A row without doc_id isn't learned from and is
    held out. An empty table gives an empty result. Extra columns are not read.
    """
    batches_of(docs.sparkSession, 256)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    fold = crc32_mod("doc_id", FOLDS)
    model = learn(docs.where(fold != HELD_OUT))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lang, score = model.predict(f["text"].tolist())
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "lang_pred": lang, "score": score})

    rows = docs.select("doc_id", "text", F.coalesce(fold == HELD_OUT, F.lit(True)).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
