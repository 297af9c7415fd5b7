"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark tasks.

Each task cuts its texts into pieces by the split pattern. Pieces it has not met yet go to an
in-process DuckDB: a recursive query joins every piece's token positions with the merge table and
contracts each piece's leftmost minimum-rank pair, until no pair of any piece can be merged. A
second query decodes the ids by an ordered aggregation over the vocabulary. Ids and decoded bytes of texts
are then put together from the pieces, and must agree with each other. No shuffle; the merge table is loaded once per Python worker.

A piece that is itself in the vocabulary is that one token, as in the tiktoken library.

Defined cases: a null text counts as empty and has no ids; decoding gives the text's UTF-8 bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taffeta.llm.batches import lean
from taffeta.llm.hashing import blocks

#: Texts of about so many characters are encoded at a time.
BLOCK_CHARS = 4 << 20
#: Pieces of a generation that a worker remembers; there are two generations.
PIECES = 400_000
#: Steps of one recursive query. What is unfinished then goes on in the next one, so that states
#: of very long pieces don't pile up.
STEPS = 48

ENCODE = f"""
with recursive step as (
  select wid, ids, 0 as n from feed
  union all
  select s.wid,
         list_concat(list_concat(s.ids[1:best.pos - 1], [best.merged]), s.ids[best.pos + 2:]) as ids, s.n + 1
  from step s
  join (
    select p.wid, min(m.merged::bigint * 4294967296 + p.pos) as least,
           (least // 4294967296)::int as merged, (least % 4294967296)::int as pos
    from (
      select wid, generate_subscripts(ids[:-2], 1) as pos, unnest(ids[:-2]) as l, unnest(ids[2:]) as r
      from step where n < {STEPS}
    ) p
    join merges m on m.l = p.l and m.r = p.r
    group by p.wid
  ) best on best.wid = s.wid
  where s.n < {STEPS}
)
select wid, arg_max(ids, n) as ids, max(n) as n from step group by wid
"""

#: Lists of ids next to each other are decoded in one group; where they part follows from their tokens' lengths.
TOGETHER = 4096

DECODE = f"""
select p.wid // {TOGETHER} as part, unhex(string_agg(v.hex, '' order by p.wid, p.pos)) as bytes
from (select wid, generate_subscripts(ids, 1) as pos, unnest(ids) as id from coded) p
join vocabulary v using (id)
group by part
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Coder:
    """Vocabulary and merge table in an in-process DuckDB of one thread."""

    def __init__(self, path: str, pattern: str, remembered: int | None = None):
        import duckdb
        import pandas as pd
        import regex
        self.find = regex.compile(pattern).findall
        self.ranks = read_ranks(path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        vocabulary = pd.DataFrame({"id": list(self.ranks.values()), "hex": [t.hex() for t in self.ranks]})
        parts = []
        for token, merged in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    parts.append((left, right, merged))
        merges = pd.DataFrame(parts, columns=["l", "r", "merged"], dtype="int32")
        for name, rows in (("vocabulary", vocabulary), ("merges", merges)):
            self.db.register("rows", rows)
            self.db.execute(f"create table {name} as select * from rows")
            self.db.unregister("rows")
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        by_id = {i: t for t, i in self.ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.token_size = np.array([len(t) for t in tokens])
        self.tokens = pa.array(tokens, pa.large_binary())
        # ids and decoded bytes of pieces; a chunk's are those of its pieces
        self.chunk_codes = self.piece_codes = Remembered(remembered or PIECES)

    def encode_pieces(self, pieces: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each piece (as int32 bytes), and the bytes that those ids decode to. Raises if these are
        not the piece's."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole = [(w, self.ranks[r]) for w, r in enumerate(raw) if r in self.ranks]
        parts = [w for w, r in enumerate(raw) if r not in self.ranks]
        data = np.frombuffer(b"".join([raw[w] for w in parts]), np.uint8)
        feed = _table(parts, _int_lists(self.single[data], [len(raw[w]) for w in parts]))
        done = [_table([w for w, _ in whole], _int_lists(np.array([i for _, i in whole], np.int32), [1] * len(whole)))]
        while feed.num_rows:
            got = self._run(ENCODE, "feed", feed)
            unfinished = pc.equal(got["n"], STEPS)
            feed = got.filter(unfinished).drop_columns("n")
            done.append(got.filter(pc.invert(unfinished)).drop_columns("n"))
        coded = pa.concat_tables(done).sort_by("wid").combine_chunks()
        lists = coded["ids"].combine_chunks()
        ids, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        back = self.decode_lists(ids, at)
        if back != raw:
            raise ValueError("ids of a piece decode to something else")
        packed, cuts = ids.tobytes(), (at * 4).tolist()
        return [packed[i:j] for i, j in zip(cuts, cuts[1:])], back

    def decode_lists(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of the lists of ids that begin and end ``at``, by the ordered aggregation."""
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
        groups = self._run(DECODE, "coded", _table(range(len(lists)), lists))
        text = b"".join(groups.sort_by("part")["bytes"].to_pylist())
        ends = np.concatenate([[0], np.cumsum(self.token_size[ids])])[at].tolist()
        return [text[i:j] for i, j in zip(ends, ends[1:])]

    def _run(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register("rows", rows)
        self.db.execute(f"create or replace temp table {name} as select * from rows")
        self.db.unregister("rows")
        return self.db.sql(sql).to_arrow_table()

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that the pattern treats apart. Where no two white-space characters meet,
        each space opens a part: it can belong to nothing but the piece that follows it."""
        if _DOUBLE(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def cut(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The ``chunks`` of all texts, and where each text's begin and end. They lie in the texts' own bytes, so that
        their places are enough."""
        raw = [t.encode() if t else b"" for t in texts]
        data, at = b"".join(raw), np.cumsum([0, *map(len, raw)], dtype=np.int64)
        opens = np.frombuffer(data, np.uint8) == 32
        opens[at[:-1][at[:-1] < len(data)]] = True
        for k, t in enumerate(texts):
            if t and _DOUBLE(t):
                sizes = [len(x.encode()) for x in self.find(t)]
                if sum(sizes) != len(raw[k]):  # the pattern leaves characters out
                    split = [self.chunks(t) if t else [] for t in texts]
                    return _listed(split)
                opens[at[k]:at[k + 1]] = False
                opens[at[k] + np.cumsum([0, *sizes[:-1]], dtype=np.int64)] = True
        starts = np.flatnonzero(opens)
        offsets = pa.py_buffer(np.append(starts, len(data)))
        return pa.Array.from_buffers(pa.large_string(), len(starts), [None, offsets, pa.py_buffer(data)]), np.searchsorted(starts, at)

    def pieces(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pieces of all chunks; the place of each chunk's first one, and their number. Chunks that open with a space are
        cut as one text, if ``chunks`` would part that in the same way."""
        spaced = np.array([c[0] == " " and not c[-1].isspace() for c in chunks], bool)
        together = list(compress(chunks, spaced))
        text = "".join(together)
        found = [] if _DOUBLE(text) else self.find(text)
        if sum(map(len, found)) != len(text):  # white space meets, or the pattern leaves characters out
            found, together, spaced[:] = [], [], False
        ends, stops = (np.cumsum([0, *map(len, x)]) for x in (found, together))
        rest = [self.find(c) for c in compress(chunks, ~spaced)]
        size = np.zeros(len(chunks), np.int64)
        size[spaced] = np.diff(np.searchsorted(ends, stops))
        size[~spaced] = [len(x) for x in rest]
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        first = np.zeros(len(chunks), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        return [*found, *chain.from_iterable(rest)], first, size

    def learn(self, pieces: list[str]) -> None:
        """Ids and decoded bytes of every piece that is not remembered."""
        new = self.piece_codes.missing(set(pieces))
        if new:
            self.piece_codes.add(new, *self.encode_pieces(new))

    def put_together(self, split: list[list[str]]) -> tuple[np.ndarray, list[int], list[bytes]]:
        """``code`` of texts that are already cut."""
        return self.code(*_listed(split))

    def code(self, chunks: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, list[int], list[bytes]]:
        """Ids of all texts, each text's number of ids, and each text's decoded bytes: those that the
        decoding query gave for its pieces. The bytes of the ids, read from the vocabulary, must be the same."""
        coded = chunks.dictionary_encode()
        found, first, size = self.pieces(_strings(coded.dictionary))
        known: dict[str, int] = {}
        number = np.array([known.setdefault(p, len(known)) for p in found], np.int64)
        self.learn(list(known))
        each = coded.indices.to_numpy()
        first, size = first[each], size[each]
        upto = np.cumsum(np.append(0, size))
        where = pa.array(number[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])])
        own, own_at = _taken(self._remembered(self.piece_codes.ids, known), where)
        text, text_at = _taken(self._remembered(self.piece_codes.decoded, known), where)
        ids, id_ends, text_ends = np.frombuffer(own, np.int32), own_at[upto[ends]] // 4, text_at[upto[ends]]
        back, back_at = _taken(self.tokens, pa.array(ids))
        if back != text or not np.array_equal(back_at[id_ends], text_ends):
            raise ValueError("ids of a text decode to something else than its pieces")
        cuts = text_ends.tolist()
        return ids, np.diff(id_ends).tolist(), [text[i:j] for i, j in zip(cuts, cuts[1:])]

    @staticmethod
    def _remembered(codes: dict[str, bytes], keys: dict[str, int]) -> pa.Array:
        return pa.array([*map(codes.__getitem__, keys)], pa.large_binary())


class Remembered:
    """Ids and decoded bytes of a bounded number of strings. There are two generations: when the younger
    one is full it becomes the older one, whose entries are lost unless they are asked for again."""

    def __init__(self, limit: int):
        self.limit, self.ids, self.decoded, self.old = limit, {}, {}, ({}, {})

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that neither generation has; afterwards the younger one has all others."""
        if len(self.ids) > self.limit:
            self.old, self.ids, self.decoded = (self.ids, self.decoded), {}, {}
        new = keys.difference(self.ids)
        again = new.intersection(self.old[0])
        self.add(again, [self.old[0].pop(k) for k in again], [self.old[1].pop(k) for k in again])
        return list(new - again)

    def add(self, keys, ids, decoded) -> None:
        self.ids.update(zip(keys, ids))
        self.decoded.update(zip(keys, decoded))


_DOUBLE = re.compile(r"\s\s").search
_coders: dict[tuple[str, str, int | None], Coder] = {}


def coder(path: str, pattern: str, remembered: int | None = None) -> Coder:
    if (path, pattern, remembered) not in _coders:
        _coders[path, pattern, remembered] = Coder(path, pattern, remembered)
    return _coders[path, pattern, remembered]


def _offsets(lengths: list[int]) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=out[1:])
    return out


def _int_lists(values: np.ndarray, lengths: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_offsets(lengths)), pa.array(values, pa.int32()))


def _binary(parts: list[bytes]) -> pa.Array:
    offsets = pa.py_buffer(_offsets([len(p) for p in parts]))
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, offsets, pa.py_buffer(b"".join(parts))])


def _listed(split: list[list[str]]) -> tuple[pa.Array, np.ndarray]:
    return pa.array([*chain.from_iterable(split)], pa.large_string()), _offsets([len(x) for x in split])


def _strings(values: pa.Array) -> list[str]:
    _, offsets, data = values.buffers()
    if not len(values):
        return []
    at = np.frombuffer(offsets, np.int64)[:len(values) + 1]
    raw = np.frombuffer(data, np.uint8)[:at[-1]]
    text = raw.tobytes().decode()
    if len(text) < len(raw):
        at = np.cumsum(np.append(0, (raw & 0xC0) != 0x80))[at]
    cuts = at.tolist()
    return [text[i:j] for i, j in zip(cuts, cuts[1:])]


def _taken(values: pa.Array, indices: pa.Array) -> tuple[bytes, np.ndarray]:
    """The values of the indices as one, and where each begins and ends."""
    out = values.take(indices)
    _, offsets, data = out.buffers()
    at = np.frombuffer(offsets, np.int64)[:len(out) + 1] if len(out) else np.zeros(1, np.int64)
    return data.to_pybytes()[:at[-1]] if data and at[-1] else b"", at


def _table(wids, ids: pa.Array) -> pa.Table:
    return pa.table({"wid": pa.array(wids, pa.int64()), "ids": ids})


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded",
           remembered: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds ``ids array<int>`` and ``decoded binary``: what the ids of a text's pieces decode to, put
    together, and compared with the vocabulary's bytes of the whole text's ids. Input columns of those
    names are replaced. ``path`` must name the rank file on every executor. ``remembered`` (for ``PIECES``)
    and ``block_chars`` trade memory for time; the result does not depend on them."""
    df = df.drop(ids, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern, remembered)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in blocks(texts, block_chars):
                flat, sizes, back = c.code(*c.cut(texts[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, _int_lists(flat, sizes), _binary(back)], names=[*batch.schema.names, ids, decoded])

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes of each id list by the ordered aggregation. A null list gives no bytes; an id
    outside the vocabulary is an error."""
    df = df.drop(decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        known = set(c.ranks.values())
        for batch in batches:
            lists = [x or [] for x in batch.column(at).to_pylist()]
            bad = {i for x in lists for i in x} - known
            if bad:
                raise ValueError(f"ids outside the vocabulary: {sorted(bad, key=str)[:5]}")
            flat = np.array([i for x in lists for i in x], np.int32)
            out = c.decode_lists(flat, _offsets([len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(out)], names=[*batch.schema.names, decoded])

    return df.mapInArrow(lean(run), schema)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id, n_tokens and the hashes of the id text and of the decoded bytes."""
    text = F.array_join(F.transform(F.col(ids), lambda i: i.cast("string")), " ")
    return df.select("doc_id", F.size(ids).cast("long").alias("n_tokens"),
                     F.sha2(text, 256).alias("ids_sha256"), F.sha2(F.col(decoded), 256).alias("decoded_sha256"))
