"""Sum-of-squares packing of tokenized documents into fixed-length sequences (operator 8).

Texts are tokenized where they are read; only the lengths of pieces travel. Pieces are dealt by
hash into groups of about GROUP, each packed by one task on its own: a piece goes where the sum,
over residual gaps, of the squared number of open bins with that gap becomes smallest. What a
group wastes in its last open bins is small against the thousands of sequences it fills.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melder.llm.common import batches_of, written

LENGTH = 2048
END_ID = 0
GROUP = 40_000  # pieces in a group, on average
ROUNDS = 6  # in which the pieces of sequences that aren't full are placed
NEARLY = 8  # tokens that a sequence may lack to count as full in these rounds
CACHE = 1_200_000  # words whose ids a Python worker remembers, from task to task
#: Fixed value: what the tokenizer's own pattern takes for one unit inside a word.
_UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_ODD = regex.compile("[\x1c-\x1f\x85\u180e\ufeff\ud800-\udfff\U00010000-\U0010ffff]")


#: Fixed value: the normalizer that Words relies on.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}


def _cuts_words(tokenizer) -> bool:
    """Whether the tokenizer's own description says what Words relies on; if not, every text goes to it whole."""
    told = json.loads(tokenizer.to_str())
    before = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = [x.get("pattern", {}).get("Regex") for x in before[:1] if x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert")]
    rest = [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in before[1:]]
    special = all("<|" in x["content"] for x in told.get("added_tokens") or [])
    return told.get("normalizer") == _NORMALIZER and split == [_UNIT.pattern] and rest == [("ByteLevel", False, False)] and special


class Words:
    """Ids of whole texts through a cache of their white-space separated words.

    The tokenizer normalizes, lower-cases, and cuts at white space and between letters, digits and
    marks before it looks at anything else, so a text's ids are those of its words' units,
    joined. Units recur far more often than words; new ones go to the tokenizer's own model.
    Texts for which this may not hold (control characters that only one side takes for white
    space, special tokens, letters beyond the basic plane) go to the tokenizer as they are.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.cuts = _cuts_words(self.tokenizer)
        self.known: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def plain(text: str) -> bool:
        return "<|" not in text and not _ODD.search(text)

    def _unit(self, u: str) -> bytes:
        got = self.units.get(u)
        if got is None:
            spelled = u if u.isascii() and u.isprintable() else "".join(map(_LETTERS.__getitem__, u.encode()))
            got = self.units[u] = struct.pack(f"<{len(ids := [t.id for t in self.model.tokenize(spelled)])}I", *ids)
        return got

    def _learn(self, words: list[str]) -> None:
        for w in words:
            # letter by letter: a word's end has no say in its lower case
            if w.isascii():
                low = w.lower()
            elif any([unicodedata.category(c) == "Cn" for c in w]):
                self.known[w] = self._whole(w)  # letters newer than one side's tables
                continue
            else:
                low = "".join([c.lower() for c in unicodedata.normalize("NFC", w)])
            self.known[w] = b"".join([self._unit(u) for u in _UNIT.findall(low)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > CACHE:
            self.known.clear()
        if len(self.units) > CACHE:
            self.units.clear()
        split = [t.split() if self.cuts and self.plain(t) else None for t in texts]
        new = {w for words in split if words for w in words if w not in self.known}
        self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) if words is not None else self._whole(t) for t, words in zip(texts, split, strict=True)]


@lru_cache(maxsize=1)
def _words(tokenizer_path: str) -> Words:
    """One for each Python worker, which Spark keeps from task to task."""
    return Words(tokenizer_path)


def _pieces(tokenizer_path: str, length: int, with_ids: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _words(tokenizer_path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for f in frames:
            rows: list[tuple] = []
            for doc, ids in zip(f["doc_id"], words.encode([t or "" for t in f["text"]]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, dtype="<u4").astype(np.int32)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return run


def place(lengths: np.ndarray, length: int = LENGTH, spare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, in the order given.

    N[g] open bins have a gap g. An item of size s changes the sum of N[g]**2 by
    2 (N[g - s] - N[g]) + 2 if it goes to a gap g > s, by 1 - 2 N[s] if it fills a gap of s, by
    2 N[length - s] + 1 if it opens a bin, by nothing if it is a bin of its own. The smallest
    change wins; ties go to the smallest gap, an open bin before a new one. With `spare` a new
    bin is no choice as long as an open one has room.
    """
    count = np.zeros(length + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    bins = 0
    none = np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        best, gap = none, -1
        if s < length:
            here = count[s:length]
            after = np.empty(length - s, dtype=np.int64)
            after[0] = 1 - 2 * count[s]
            after[1:] = 2 * (count[1 : length - s] - here[1:]) + 2
            after[here == 0] = none
            g = int(after.argmin())
            best, gap = int(after[g]), s + g
        if best == none or not spare and 2 * count[length - s] + 1 < best:
            where[k], offset[k], left = bins, 0, length - s
            bins += 1
        else:
            where[k], offset[k], left = open_bins[gap].pop(), length - gap, gap - s
            count[gap] -= 1
        if left:
            open_bins[left].append(int(where[k]))
            count[left] += 1
    return where, offset


def place_again(lengths: np.ndarray, length: int = LENGTH, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """place() with further rounds: items of bins that aren't nearly full are taken out and placed once more by
    the same rule, longest first and in a drawn order by turns; the round with the fewest bins counts."""
    where, offset = place(lengths, length)
    best = where, offset
    done, open_items = 0, np.arange(len(lengths))
    for r in range(1, rounds):
        count = int(where[open_items].max()) + 1 if len(open_items) else 0
        fill = np.bincount(where[open_items] - done, weights=lengths[open_items], minlength=count - done)
        full = fill >= length - NEARLY
        # full bins get the next numbers for good, in the order in which they were opened
        number = done + np.cumsum(full) - 1
        local = where[open_items] - done
        where, offset = where.copy(), offset.copy()
        where[open_items[full[local]]] = number[local[full[local]]]
        open_items = open_items[~full[local]]
        done += int(full.sum())
        if not len(open_items):
            break
        order = open_items[np.argsort(-lengths[open_items], kind="stable")] if r % 2 else np.random.default_rng(r).permutation(open_items)
        bins, at = place(lengths[order], length)
        where[order], offset[order] = bins + done, at
        if where.max() < best[0].max():
            best = where, offset
    return best


def _place(length: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        # Long pieces first: each starts a bin or ends one, and the short ones find many gaps.
        g = g.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        where, offset = place_again(g["length"].to_numpy(), length)
        return g.assign(sequence_id=(g["part"].to_numpy() << 32) + where, offset=offset).drop(columns="part")

    return run


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of docs(doc_id, text).

    A document is its ids and one END_ID; only documents over `length` are cut. Null is empty:
    the END_ID alone.
    """
    batches_of(docs.sparkSession, 256)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_pieces(tokenizer_path, length, with_ids), schema)


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """pieces() with sequence_id and offset: each sequence is gapless from 0 and at most `length`.

    Rows with null or repeated doc_id are packed like any other. An empty table gives an empty
    result; columns other than doc_id and text are not read.
    """
    cut = written(pieces(docs, tokenizer_path, length), "pieces")
    groups = max(1, round(cut.count() / GROUP))
    # by a row's number in the written table: rows alike would all hash to one group
    dealt = cut.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(_place(length), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """sequence_id, ids, doc_ids: the packed sequences themselves, of bounded size each. Repeated
    rows are packed as often as they occur; their equal ids are made once and joined to each."""
    key = ["doc_id", "piece", "length", "ids_crc32"]
    placed = pack(docs, tokenizer_path, length).select(*key, "sequence_id", "offset")
    whole = pieces(docs, tokenizer_path, length, with_ids=True).dropDuplicates(key)
    on = [whole[k].eqNullSafe(placed[k]) for k in key]
    both = placed.join(whole, on).select(placed["sequence_id"], placed["offset"], whole["doc_id"], whole["ids"])
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return both.groupBy("sequence_id").agg(inside.alias("x")).select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"))
