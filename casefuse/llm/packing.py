"""Best-fit decreasing packing of tokenised documents into fixed windows.

Documents are tokenised where they lie. Those longer than a window are cut into full windows and a
rest; rests go, longest first, into the open window they fit most tightly, found with a segment
tree over remaining capacity. Packing needs lengths only, so just the list of pieces is dealt into
groups; a group holds thousands of windows, and only its last few are left under-filled.
"""

import os
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefuse.llm.common import mix64, row_order, written

WINDOW = 4096
END_ID = 2
#: A group packs about this many tokens, and at most about this many pieces.
GROUP_TOKENS, GROUP_PIECES = 1 << 24, 1 << 18
#: Parts of chunks remembered by a worker, twice over (a full memory becomes the older).
WORDS_KEPT = 500_000
#: Letters and marks behind them. The apostrophe is left out: the tokenizer cuts `'s` and the like off.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
WORD_AND_MARKS = rf"^(?P<word>[{LATIN}]+)(?P<marks>[.,;:!?*$%&#<>|\"()\[\]]*)$"
LETTERS = re.compile(rf"[{LATIN}]+")
#: Words that are tokenised in one text.
JOINED = 64


def _gathered(ids: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the items `at` in turn, and where each begins; `size` are those of all items."""
    length, first = size[at], (np.cumsum(size) - size)[at]
    upto = np.append(0, np.cumsum(length))
    return ids[np.repeat(first - upto[:-1], length) + np.arange(upto[-1])], upto


class WordMemory:
    """Token ids of white-space-free chunks, as little-endian 32-bit bytes.

    The tokenizer never joins across white space, and its added tokens hold none, so a text's ids
    are those of its chunks in turn. It ignores case and cuts between a letter and a punctuation
    mark, so a chunk of Latin letters and marks behind them is put together from its two parts.
    Parts are remembered, in small letters, and a chunk that is not made like this is its own part.
    """

    _loaded = {}

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        # Parts in the order they were met, whether they were met lately, their ids and how many.
        self.parts, self.met = pa.array([], pa.large_string()), np.zeros(0, bool)
        self.ids, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int32)
        # Tokens that end a word, where the tokenizer marks them.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    @classmethod
    def load(cls, path: str, plain_specials: bool = False) -> "WordMemory":
        key = path, plain_specials
        if key not in cls._loaded:
            cls._loaded[key] = cls(path, plain_specials)
        return cls._loaded[key]

    @property
    def new(self) -> pa.Array:
        """Parts that were met lately."""
        return self.parts.filter(pa.array(self.met))

    @property
    def old(self) -> pa.Array:
        """Parts that were not met since the last time that some were forgotten."""
        return self.parts.filter(pa.array(~self.met))

    def _encoded(self, texts: list) -> list:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids := one.ids)}I", *ids) for one in found]

    def _learned(self, parts: list) -> list:
        """The ids of new parts.

        Words of letters are tokenised many in a text, and the tokens that end a word tell them apart.
        Each word has at most one; where some have none, they are tokenised one by one.
        """
        new, words, others = {}, [], []
        for part in parts:
            (words if LETTERS.fullmatch(part) else others).append(part)
        for i in range(0, len(words), 64 * JOINED):
            some = words[i:i + 64 * JOINED]
            raw = b"".join(self._encoded([" ".join(some[j:j + JOINED]) for j in range(0, len(some), JOINED)]))
            stops = 4 * np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 4
            if len(stops) == len(some):
                at = [0, *stops.tolist()]
                new.update(zip(some, [raw[a:b] for a, b in zip(at, at[1:])]))
            else:
                others += some
        for i in range(0, len(others), 4096):
            some = others[i:i + 4096]
            new.update(zip(some, self._encoded(some)))
        return [new[part] for part in parts]

    def _remember(self, parts: pa.Array) -> None:
        """Put new parts behind those that are known."""
        learned = self._learned(parts.to_pylist())
        self.parts = pa.concat_arrays([self.parts, parts])
        self.met = np.append(self.met, np.zeros(len(parts), bool))
        self.ids = np.append(self.ids, np.frombuffer(b"".join(learned), "<u4"))
        self.size = np.append(self.size, np.fromiter(map(len, learned), np.int32, len(learned)) // 4)

    def _forget(self) -> None:
        """Keep only parts that were met lately, and from now on count anew what is met."""
        self.ids, self.parts = self.ids[np.repeat(self.met, self.size)], self.new
        self.size = self.size[self.met]
        self.met = np.zeros(len(self.parts), bool)

    def encode(self, texts) -> list:
        """Ids of each text (bytes, or an Arrow column; null is empty), as bytes of 32-bit numbers.

        Arrow cuts the texts, numbers their distinct chunks, cuts these and numbers their distinct
        parts, the known ones first; only new parts become Python strings.
        """
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_binary())
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        numbered = split.flatten().dictionary_encode()
        chunks = numbered.dictionary
        cut_up = pc.extract_regex(chunks, WORD_AND_MARKS)
        whole = pc.is_null(cut_up)
        front = pc.if_else(whole, chunks, pc.utf8_lower(pc.struct_field(cut_up, 0)))
        behind = pc.if_else(whole, "", pc.struct_field(cut_up, 1))
        known = len(self.parts)
        both = pa.concat_arrays([self.parts, front, behind]).dictionary_encode()
        self._remember(both.dictionary[known:])
        halves = both.indices.to_numpy()[known:].reshape(2, len(chunks))
        self.met[halves] = True
        ids, _ = _gathered(self.ids, self.size, halves.T.ravel())
        ids, upto = _gathered(ids, self.size[halves].sum(axis=0), numbered.indices.to_numpy())
        if np.count_nonzero(self.met) > WORDS_KEPT:
            self._forget()
        ends = upto[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def cut(ids: bytes, window: int) -> list:
    """(start, ids) of full windows and of the rest."""
    step = 4 * window
    return [(i // 4, ids[i:i + step]) for i in range(0, len(ids), step)]


def _some(texts: pa.Array, size: int = 1 << 22):
    """The texts in runs of about `size` bytes, which are not copied."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    last = np.flatnonzero(np.diff(upto // size)) + 1
    for a, b in zip([0, *last.tolist()], [*last.tolist(), len(texts)]):
        if a < b:
            yield texts.slice(a, b - a)


def tokenised(text: Column, path: str, window: int = WINDOW, end_id: int = END_ID,
              keep_ids: bool = False, plain_specials: bool = False) -> Column:
    """Array of pieces (start, length, ids_crc32 and, if asked for, ids) of a text and its end id."""
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kind = "start: long, length: long, ids_crc32: long"
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        kind += ", ids: array<int>"
    end = np.array([end_id], "<u4").tobytes()

    @F.arrow_udf(f"array<struct<{kind}>>")
    def pieces(texts: pa.Array) -> pa.Array:
        memory, columns, offsets = WordMemory.load(path, plain_specials), [[] for _ in fields], [0]
        for run in _some(texts):
            for ids in memory.encode(run):
                for start, part in cut(ids + end, window):
                    row = (start, len(part) // 4, zlib.crc32(part))
                    for column, value in zip(columns, row):
                        column.append(value)
                    if keep_ids:
                        columns[3].append(np.frombuffer(part, "<u4").astype(np.int32))
                offsets.append(len(columns[0]))
        inner = pa.StructArray.from_arrays(
            [pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])
        pa.default_memory_pool().release_unused()
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)
    return pieces(text)


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length; `lengths` come longest first.

    Leaf c of the tree counts the open windows with c free places. The tightest fit is the first
    counted leaf from the length upwards: climb until a right sibling counts, then descend left.
    """
    leaves = 1 << int(window).bit_length()
    tree = [0] * (2 * leaves)
    free = [[] for _ in range(window + 1)]
    at, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0

    def count(leaf, by):
        node = leaf + leaves
        while node:
            tree[node] += by
            node >>= 1

    for i, need in enumerate(lengths.tolist()):
        node = need + leaves
        if not tree[node]:
            while node > 1 and (node % 2 or not tree[node + 1]):
                node >>= 1
            node += node > 1
        if node > 1:
            while node < leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
            room = node - leaves
            number = free[room].pop()
            count(room, -1)
        else:
            number, room = opened, window
            opened += 1
        at[i], offset[i] = number, window - room
        if room > need:
            free[room - need].append(number)
            count(room - need, 1)
    return at, offset


def packed_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add `sequence_id, offset` to pieces with `at, start, length`."""
    pieces, seen = written(pieces, "pieces", total=F.sum("length"), n=F.count(F.lit(1)))
    groups = max(1, -(-(seen["total"] or 0) // GROUP_TOKENS), -(-seen["n"] // GROUP_PIECES))
    dealt = pieces.withColumn("group", F.pmod(mix64(F.col("at"), F.col("start"), seed=3),
                                              F.lit(groups)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "at", "start"], ascending=[False, True, True])
        number, offset = best_fit(group["length"].to_numpy(), window)
        return group.assign(sequence_id=(group["group"].to_numpy() << 32) + number, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return dealt.groupBy("group").applyInPandas(
        pack, f"{schema}, sequence_id long, offset long").drop("group")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False,
         plain_specials: bool = False) -> DataFrame:
    """Pieces of all documents with their place: `doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset` (and `ids`).

    `tokenizer` is the path of a tokenizer file that every executor can read. The strings of its
    added tokens become these tokens, with `plain_specials` they are ordinary text. A null or blank text
    is its end id alone. Repeated rows are packed each for itself, null ids are kept, an empty
    table gives no rows, further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), row_order(docs).alias("at"), tokenised(
        F.col(text_col), tokenizer, window, end_id, keep_ids, plain_specials).alias("pieces"))
    rows = rows.select("doc_id", "at", F.aggregate(
        "pieces", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("doc_tokens"),
        F.explode("pieces").alias("p")).select("doc_id", "at", "p.*", "doc_tokens")
    out = packed_pieces(rows, window)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                      "offset", *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """`sequence_id, ids, n_tokens`: the windows themselves, padded; needs pieces with `ids`."""
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))),
                                lambda p: p["ids"]))
    rows = packed.groupBy("sequence_id").agg(ids.alias("ids"), F.sum("length").alias("n_tokens"))
    return rows.select("sequence_id", F.concat("ids", F.array_repeat(
        F.lit(pad_id), F.lit(window) - F.size("ids"))).alias("ids"), "n_tokens")
