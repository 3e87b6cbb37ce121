"""Hierarchical best-fit packing of tokenized documents into sequences of a fixed length.

Round one deals the pieces to tasks of a bounded number of items. Each task packs its items by
best fit, longest first, emits the bins that are nearly full and passes the others on. The next
round has fewer tasks and takes those bins as its items, and so on up to one task.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.sources.scratch import materialize

#: Items that one task packs.
TASK_ITEMS = 20_000
#: A bin is emitted when at most this share of it is empty.
NEARLY_FULL = 0.005
#: Words that are taken whole, and stems of words, whose ids a worker keeps at hand, twice over. It
#: only saves time.
CACHED_WORDS = 50_000
CACHED_STEMS = 200_000
#: Bytes of text whose words are encoded together.
ENCODED_AT_ONCE = 4_000_000
#: Words of more characters are not kept.
LONG_WORD = 64

# Words of small Latin letters, and the points and commas at the end of a word.
_LATIN = "^[a-zß-öø-ÿ]+$"
_TAIL = "(?P<tail>[.,]*)$"

# Pieces of text keep their ids as little-endian numbers of 32 bits.
_UINT32 = next(code for code in "IL" if array(code).itemsize == 4)

_PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
_BINS = f"sequence_id bigint, used bigint, closed boolean, members array<{_PIECE}>"


def _kept_in_worker(name: str, make):
    """What a worker process makes once and keeps for its later tasks. Functions of this package
    come to a worker anew with each task, and so would variables of a module."""
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


class WordIds:
    """The ids of texts, as bytes (little-endian, 32 bits each).

    For tokenizers that lower the case, drop white space and never join what white space
    separates: the ids of a text are those of its words one after the other. Arrow lowers A to Z,
    splits some megabytes of texts, finds their distinct words and takes points and commas off the
    ends of those that else have Latin letters only, as the tokenizer does. Only stems that are not
    at hand are encoded, and the ids of all words are put in place at once.
    """

    def __init__(self, tokenizer_path: str):
        # Spark runs a worker on each core; threads of the tokenizer would only fight for them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.stems: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _learn(self, words: list[str], plain: list[bool]) -> list[bytes]:
        """The ids of distinct stems. Plain ones need no normalizer and no pattern: the model
        takes them as they are."""
        if len(self.stems) > CACHED_WORDS + CACHED_STEMS:
            # Those in use come back from the older half.
            self.older, self.stems = self.stems, {"": b""}
        stems, older = self.stems, self.older
        rest = []
        for word, letters in zip(words, plain, strict=True):
            if word in stems:
                continue
            if word in older:
                stems[word] = older[word]
            elif letters:
                symbols = word if word.isascii() else self.to_bytes.pre_tokenize_str(word)[0][0]
                stems[word] = array(_UINT32, [token.id for token in self.model.tokenize(symbols)]).tobytes()
            else:
                rest.append(word)
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        for word, encoding in zip(rest, found, strict=True):
            stems[word] = array(_UINT32, encoding.ids).tobytes()
        ids = list(map(stems.__getitem__, words))
        for word in [word for word in words if len(word) > LONG_WORD]:
            del stems[word]
        return ids

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after the other, and how many each has."""
        bare = pc.ascii_rtrim(words, ".,")
        plain = pc.match_substring_regex(bare, _LATIN)
        stems = pc.if_else(plain, bare, words).dictionary_encode()
        tails = pc.if_else(plain, pc.struct_field(pc.extract_regex(words, _TAIL), "tail"), "").dictionary_encode()
        held, sizes = [], []
        for part in (stems, tails):
            letters = pc.match_substring_regex(part.dictionary, _LATIN)
            # By way of numpy, as Arrow makes a list of its strings one by one.
            distinct, letters = (c.to_numpy(zero_copy_only=False).tolist() for c in (part.dictionary, letters))
            ids = self._learn(distinct, letters)
            held.append(np.frombuffer(b"".join(ids), "<u4"))
            sizes.append(np.array([len(i) // 4 for i in ids], np.int64))
        pieces = np.stack([stems.indices.to_numpy(), tails.indices.to_numpy() + len(sizes[0])], axis=1)
        return _placed(np.concatenate(held), np.concatenate(sizes), pieces.reshape(-1), 2)

    def _encode(self, texts: pa.Array) -> Iterator[bytes]:
        # A copy, as not all of these functions mind where a slice begins.
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.concat_arrays([texts])))
        words = split.flatten().dictionary_encode()
        held, sizes = self._word_ids(words.dictionary)
        out, counts = _placed(held, sizes, words.indices.to_numpy(), 1)
        ends = np.concatenate([[0], np.cumsum(counts)])
        lists = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        data, bounds = out.tobytes(), (4 * ends[lists]).tolist()
        for begin, end in zip(bounds, bounds[1:]):
            yield data[begin:end]

    def __call__(self, texts: pa.Array | list) -> Iterator[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + ENCODED_AT_ONCE)))
            yield from self._encode(texts[at:to])
            at = to


def _placed(held: np.ndarray, sizes: np.ndarray, order: np.ndarray, together: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``held``, of ``sizes`` each, in a given order; and the sizes of each ``together``."""
    starts, counts = (np.cumsum(sizes) - sizes)[order], sizes[order]
    places = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    places += np.arange(len(places))
    return held[places], counts.reshape(-1, together).sum(axis=1)


def word_ids(tokenizer_path: str) -> WordIds:
    """The encoder of a worker process, with the words that it has met."""
    name = "word_ids_" + tokenizer_path
    return _kept_in_worker(name, lambda: WordIds(tokenizer_path))


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, limit: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's ids followed by ``end_id``,
    cut into pieces of ``limit`` ids where it is longer. A null text is an empty one: its only id
    is ``end_id``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path)
        for batch in batches:
            rows = []
            ids = encode(batch.column("text"))
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                body += end
                for piece, at in enumerate(range(0, len(body), 4 * limit)):
                    part = body[at : at + 4 * limit]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: the bin of each item, its offset there, and each bin's fill.

    Bins are kept by free space, and a number with one bit per free space tells the tightest one
    that fits, so a step costs the same however many bins are open.
    """
    place = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    spaces = 0
    for item in np.argsort(-lengths, kind="stable"):
        length = int(lengths[item])
        fits = spaces >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            chosen = open_bins[space].pop()
            if not open_bins[space]:
                spaces &= ~(1 << space)
        else:
            chosen, space = len(fill), limit
            fill.append(0)
        place[item], offset[item] = chosen, fill[chosen]
        fill[chosen] += length
        left = space - length
        if left:
            open_bins[left].append(chosen)
            spaces |= 1 << left
    return place, offset, np.array(fill, np.int64)


def _pack_round(items: DataFrame, tasks: int, number: int, limit: int, last: bool) -> DataFrame:
    """One round over ``used, members``; sequence ids tell round, task and bin."""
    least = limit if last else limit - int(limit * NEARLY_FULL)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        place, offset, fill = best_fit(table.column("used").to_numpy(), limit)
        order = np.argsort(place, kind="stable")
        lists = table.column("members").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        lists = lists.take(pa.array(order))
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        moved = flat.field("offset").to_numpy() + np.repeat(offset[order], counts)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        pieces = pa.StructArray.from_arrays(
            [*(flat.field(n) for n in names), pa.array(moved)], [*names, "offset"]
        )
        members = np.bincount(place[order], weights=counts, minlength=len(fill)).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(members)]).astype(np.int32)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((number << 56) + (task << 32) + np.arange(len(fill))),
                pa.array(fill),
                pa.array((fill >= least) | last),
                pa.ListArray.from_arrays(pa.array(ends), pieces),
            ],
            ["sequence_id", "used", "closed", "members"],
        )

    return items.select("used", "members").repartition(tasks).mapInArrow(pack, _BINS)


def pack_pieces(pieces: DataFrame, limit: int, task_items: int = TASK_ITEMS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces of at most ``limit`` ids.

    Every piece gets a place and no sequence holds more than ``limit`` ids. A piece of full
    length is a sequence by itself and skips the rounds. No task gets more than about
    ``task_items`` items: there are as many tasks as that asks for, and when a round has closed
    hardly any bin (what is left doesn't go together) its open bins are emitted as they are.
    """
    whole = F.col("length") == limit
    piece = F.struct(
        "doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("bigint").alias("offset")
    )
    items = pieces.where(~whole).select(F.col("length").alias("used"), F.array(piece).alias("members"))
    count, rounds, number = items.count(), [], 0
    while count:
        number += 1
        tasks = -(-count // task_items)
        bins = materialize(_pack_round(items, tasks, number, limit, last=tasks == 1), f"bins{number}")
        items = bins.where("not closed")
        left = items.count()
        rounds.append(bins.where("closed"))
        if left > 0.9 * count:
            rounds.append(items)
            left = 0
        count = left
    full = pieces.where(whole).select(
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(limit).cast("bigint").alias("used"),
        F.lit(True).alias("closed"),
        F.array(piece).alias("members"),
    )
    for bins in rounds:
        full = full.unionAll(bins)
    return full.select("sequence_id", F.explode("members").alias("m")).select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset"
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, limit: int = 4096,
    task_items: int = TASK_ITEMS,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for all ``docs``.

    Needs ``doc_id`` and ``text``; other columns are ignored. Null and empty texts are documents
    of one id. Rows that repeat are documents of their own, also with a null ``doc_id``. An empty
    table gives an empty result. ``ids_crc32`` is over the piece's ids as unsigned little-endian
    32-bit numbers.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, end_id, limit), "pieces")
    return pack_pieces(pieces, limit, task_items)
