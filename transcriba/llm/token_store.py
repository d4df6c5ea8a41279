"""Token ids in binary shards, with a minimal perfect hash index from document keys to shard offsets.

Shard file (little endian): 32-byte header (magic, id width 2 or 4, records, ids), the raw ids of all
records one after another, then records + 1 running id counts as unsigned 64-bit. Index file of one
key bucket: 32-byte header (magic, keys, groups, seed), int32 displacement of each group, then by slot:
uint32 fingerprint, uint32 shard, uint64 first record, uint32 records. A lookup hashes the key once,
reads one displacement and one slot, and compares the fingerprint: constant time at any size.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, named, partitions, shared_dir

SHARD_MAGIC, INDEX_MAGIC = b"TRSHARD1", b"TRINDEX1"
#: Keys of one index bucket, about.
BUCKET_KEYS = 1 << 16
#: The key of records whose id is null.
NULL_KEY = -(1 << 63)
#: Distinct pieces of text that a worker remembers.
CACHE_PIECES = 400_000


# -- encoding ---------------------------------------------------------------------------------------


#: White space of any table that ever was: no cut may come at a space before it.
ODD_SPACES = tuple(chr(c) for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def pieces(text: str) -> list[str]:
    """The text cut at spaces where byte-level BPE never merges: at a space that a word follows.

    The space itself is left out; it belongs to the piece after it.
    """
    parts = text.split(" ")
    # A search for one character is the fastest there is, and most kinds of white space are in no text.
    if not text.endswith(" ") and "  " not in text and not any(c in text and " " + c in text for c in ODD_SPACES):
        return parts
    out = parts[:1]
    for part in parts[1:]:
        if part and part[0] not in ODD_SPACES:
            out.append(part)
        else:
            out[-1] += " " + part
    return out


#: How byte-level BPE of this family splits ASCII into words; for any other character the library is asked.
ASCII_WORDS = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\v\f\r A-Za-z0-9]+|[\t\n\v\f\r ]+(?![^\t\n\v\f\r ])|[\t\n\v\f\r ]+""")


#: What stands for a letter beyond ASCII where only the kinds of characters count.
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
#: Marks that end a word and are no letter, digit or space, nor begin a contraction.
MARKS = ".,;:!?"


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer file is one whose ids may be put together piece by piece: byte-level BPE with the
    usual word pattern, without normaliser, prefix space, dropout, affixes, or added tokens that reach over spaces."""
    model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    bare = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    added = [t for t in spec.get("added_tokens", []) if " " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].isalpha()]
    return model.get("type") == "BPE" and spec.get("normalizer") is None and plain and bare and not added


class Recent(dict):
    """What a function made of the keys that were asked for of late. Those of before the last ageing are looked up first, then made anew."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        got = self[key] = self.make(key) if got is None else got
        return got

    def age(self) -> None:
        self.old = self.copy()
        self.clear()


class PieceEncoder:
    """A byte-level BPE tokenizer with the pieces that this worker has met; lives as long as the worker."""

    def __init__(self, path: str, width: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.kind = Tokenizer.from_file(path), "<u2" if width == 2 else "<u4"
        self.code = "H" if width == 2 else "I"
        with open(path, encoding="utf-8") as f:
            self.by_piece = splits_at_spaces(json.load(f))
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        if self.by_piece:
            self.tokenize = self.tok.model.tokenize
        # Byte-level vocabularies write each byte as one printable character.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.after = Recent(self.follow)  # pieces that follow a space, without it
        self.inner = Recent(lambda w: self.one(self.written(w)))  # words inside a piece
        self.wide = Recent(self.one)  # those that the library found, as the vocabulary writes them
        self.alpha: set[str] = set()  # characters that the library takes for letters
        self.other: set[str] = set()  # and those that it does not

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def written(self, word: str) -> str:
        """A word as the vocabulary writes it."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", "\u0120")
        return word.encode().decode("latin-1").translate(self.letters)

    def one(self, written: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenize(written)]).tobytes()

    def all_letters(self, p: str) -> bool:
        if self.alpha.issuperset(p):
            return True
        for c in set(p) - self.alpha - self.other:  # a letter joins the letter before it
            (self.alpha if len(self.tok.pre_tokenizer.pre_tokenize_str("a" + c)) == 1 else self.other).add(c)
        return self.alpha.issuperset(p)

    def piece(self, p: str) -> bytes:
        """Ids of a piece that is not letters alone, and the space before it."""
        if any(a in p for a in self.added):
            return self.whole(" " + p)
        text = " " + p
        if p.isascii():
            words = ASCII_WORDS.findall(text)
        elif self.all_letters("".join(BEYOND_ASCII.findall(p))):  # any other letter splits as an ASCII one does
            words = [text[m.start() : m.end()] for m in ASCII_WORDS.finditer(BEYOND_ASCII.sub("a", text))]
        else:
            return b"".join([self.wide[w] for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)])
        first, inner = words[0], self.inner
        if len(first) > 1 and self.alpha.issuperset(first[1:]):
            return self.after[first[1:]] + b"".join([inner[w] for w in words[1:]])
        return b"".join([inner[w] for w in words])

    def follow(self, p: str) -> bytes:
        """Ids of a piece and the space before it, the commonest kinds first: letters, and letters with one mark at their end."""
        alpha = self.alpha
        if not alpha.issuperset(p):
            if p[-1] in MARKS and alpha.issuperset(p[:-1]) and len(p) > 1:
                return self.after[p[:-1]] + self.inner[p[-1]]
            if not self.all_letters(p):
                return self.piece(p)
        return array(self.code, [t.id for t in self.tokenize("\u0120" + p if p.isascii() else self.written(" " + p))]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.after) + len(self.inner) + len(self.wide) > CACHE_PIECES // 2:
            for held in (self.after, self.inner, self.wide):
                held.age()
        get, out = self.after.__getitem__, []
        for t in texts:
            head, *body = pieces(t)
            out.append(self.whole(head) + b"".join(map(get, body)))
        return out


def encode(texts: list[str], path: str, width: int) -> list[bytes]:
    """Ids of each text as little-endian integers of the given width; no special tokens are added.

    They are the library's for every text. Where the file allows it (splits_at_spaces), each piece that the
    worker has not met is encoded once, word by word, by the tokenizer's model; else whole texts are.
    """
    held = sys.__dict__.setdefault("_transcriba_tokenizers", {})
    if (path, width) not in held:
        held[path, width] = PieceEncoder(path, width)
    own = held[path, width]
    if own.by_piece:
        return own.encode(texts)
    return [np.array(e.ids, own.kind).tobytes() for e in own.tok.encode_batch_fast(texts, add_special_tokens=False)]


def forget_pieces() -> None:
    """Frees the tokenizers and pieces of this worker: the tasks that follow the encoding have no use for them."""
    sys.__dict__.pop("_transcriba_tokenizers", None)


# -- minimal perfect hash ---------------------------------------------------------------------------


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over integer keys."""
    z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _parts(keys: np.ndarray, n: int, groups: int, seed: int):
    a, b = mix(keys, seed), mix(keys, seed + 1)
    return (a % np.uint64(groups)).astype(np.int64), (a >> np.uint64(32)).astype(np.uint64), b | np.uint64(1), (b >> np.uint64(32)).astype(np.uint32)


def build_mph(keys: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Seed, displacements and each key's slot, for distinct keys: hash, displace, largest groups first.

    A group of one key stores its slot itself, as -slot - 1.
    """
    n = len(keys)
    groups = max(1, n // 4)
    for seed in range(1, 200, 2):
        g, f0, f1, _ = _parts(keys, n, groups, seed)
        order = np.argsort(g, kind="stable")
        sizes = np.bincount(g, minlength=groups)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        taken, disp, slot = np.zeros(n, bool), np.zeros(groups, np.int32), np.full(n, -1, np.int64)
        ok = True
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = order[starts[b] : starts[b + 1]]
            base, step = f0[own][:, None], f1[own][:, None]
            done = False
            for d0 in range(0, 1 << 20, 512):
                d = np.arange(d0, d0 + (512 if d0 else 32), dtype=np.uint64) if d0 or n > 64 else np.arange(512, dtype=np.uint64)
                at = ((base + d * step) % np.uint64(n)).astype(np.int64)
                free = ~taken[at].any(0)
                if free.any():
                    for c in np.flatnonzero(free):
                        if len(np.unique(at[:, c])) == len(own):
                            disp[b], slot[own], done = int(d[c]), at[:, c], True
                            taken[at[:, c]] = True
                            break
                if done:
                    break
            if not done:
                ok = False
                break
        if not ok:
            continue
        singles = order[np.isin(g[order], np.flatnonzero(sizes == 1))]
        free = np.flatnonzero(~taken)
        slot[singles] = free[: len(singles)]
        disp[g[singles]] = -slot[singles] - 1
        return seed, disp, slot
    raise RuntimeError("no perfect hash found: are the keys distinct?")


def index_bytes(keys: np.ndarray, shard: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    """The index file of one bucket."""
    n = len(keys)
    seed, disp, slot = build_mph(keys)
    finger = _parts(keys, n, len(disp), seed)[3]
    by = np.empty(n, np.int64)
    by[slot] = np.arange(n)
    return struct.pack("<8sQII8x", INDEX_MAGIC, n, len(disp), seed) + disp.astype("<i4").tobytes() + finger[by].astype("<u4").tobytes() + shard[by].astype("<u4").tobytes() + first[by].astype("<u8").tobytes() + count[by].astype("<u4").tobytes()


class Index:
    """One bucket's index file, opened."""

    def __init__(self, raw: bytes) -> None:
        magic, self.n, m, self.seed = struct.unpack_from("<8sQII", raw)
        if magic != INDEX_MAGIC:
            raise ValueError("not an index file")
        at, out = 32, []
        for kind, k in (("<i4", m), ("<u4", self.n), ("<u4", self.n), ("<u8", self.n), ("<u4", self.n)):
            out.append(np.frombuffer(raw, kind, k, at))
            at += out[-1].nbytes
        self.disp, self.finger, self.shard, self.first, self.count = out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and whether the stored fingerprint is the key's."""
        g, f0, f1, finger = _parts(keys, self.n, len(self.disp), self.seed)
        d = self.disp[g].astype(np.int64)
        at = np.where(d < 0, -d - 1, ((f0 + np.maximum(d, 0).astype(np.uint64) * f1) % np.uint64(self.n)).astype(np.int64))
        return at, self.finger[at] == finger


# -- files ------------------------------------------------------------------------------------------


def write_file(uri: str, chunks: Iterator[bytes]) -> None:
    f, path = pafs.FileSystem.from_uri(uri)
    f.create_dir(path.rpartition("/")[0], recursive=True)
    with f.open_output_stream(path) as out:
        for c in chunks:
            out.write(c)


def read_file(uri: str) -> bytes:
    f, path = pafs.FileSystem.from_uri(uri)
    with f.open_input_file(path) as src:
        return src.read()


class Shard:
    """A shard file: random access to records, reading ahead by a window."""

    WINDOW = 8 << 20

    def __init__(self, uri: str) -> None:
        f, path = pafs.FileSystem.from_uri(uri)
        self.src = f.open_input_file(path)
        magic, self.width, self.records, self.ids = struct.unpack("<8sIQQ", self.src.read_at(28, 0))
        if magic != SHARD_MAGIC:
            raise ValueError("not a shard file")
        self.ends = np.frombuffer(self.src.read_at(8 * (self.records + 1), 32 + self.width * self.ids), "<u8").astype(np.int64)
        self.at, self.held = 0, b""

    def record(self, i: int) -> bytes:
        a, b = self.width * int(self.ends[i]), self.width * int(self.ends[i + 1])
        if a < self.at or b > self.at + len(self.held):
            self.at, self.held = a, self.src.read_at(max(self.WINDOW, b - a) if a + self.WINDOW < self.width * self.ids else self.width * self.ids - a, 32 + a)
        return self.held[a - self.at : b - self.at]


class TokenStore:
    """Written shards and their index.

    shards: shard, file, records, ids, start (ids before it). index: bucket, file, keys.
    """

    def __init__(self, spark: SparkSession, shards: DataFrame, index: DataFrame, buckets: int) -> None:
        self.spark, self.shards, self.index, self.buckets = spark, shards, index, buckets

    def lookup(self, keys: DataFrame) -> DataFrame:
        """shard, first, count of each distinct key of the single column of keys; unknown keys give no row."""
        key = F.coalesce(named(keys.columns[0]).cast("long"), F.lit(NULL_KEY))
        asked = keys.select(key.alias("key")).distinct().withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        asked = asked.join(self.index.select("bucket", "file"), "bucket").select("bucket", "file", "key")
        asked = asked.repartition(partitions(self.spark), "bucket").sortWithinPartitions("bucket")

        def find(batches):
            forget_pieces()
            held, name = None, None
            for batch in batches:
                bucket, files, key = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if files[a].as_py() != name:
                        name = files[a].as_py()
                        held = Index(read_file(name))
                    at, ok = held.find(key[a:b])
                    at = at[ok]
                    yield pa.record_batch([pa.array(key[a:b][ok]), pa.array(held.shard[at].astype(np.int32)), pa.array(held.first[at].astype(np.int64)), pa.array(held.count[at].astype(np.int64))], ["key", "shard", "first", "count"])

        return asked.mapInArrow(find, "key long, shard int, first long, count long")

    def records(self, keys: DataFrame) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, shard of every record of the given keys, read from the files."""
        asked = self.lookup(keys).join(self.shards.select("shard", "file", "start"), "shard").select("shard", "file", "start", "first", "count", "key")
        asked = asked.repartition(partitions(self.spark), "shard").sortWithinPartitions("shard", "first")

        def read(batches):
            forget_pieces()
            shard, name = None, None
            for batch in batches:
                rows = []
                for s, file, start, first, count, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if file != name:
                        shard, name = Shard(file), file
                    for i in range(first, first + count):
                        raw = shard.record(i)
                        wide = raw if shard.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                        rows.append((None if key == NULL_KEY else key, start + int(shard.ends[i]), len(wide) // 4, zlib.crc32(wide), s))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.int32()], strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

        return asked.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2, bucket_keys: int = BUCKET_KEYS) -> TokenStore:
    """Encodes whole texts, adds end_id to each, and writes shards in ascending id order with their index.

    Null texts count as empty and hold the end id alone. Null ids come first, under one key of their
    own. Rows that share an id are separate records of one key, in the order of their texts' hashes.
    Other columns are ignored. Each shard is what one range of ids holds; a file's name carries the
    attempt that wrote it, and only attempts that succeed are listed, so a lost executor's files are
    never read. width 2 holds ids below 65,536.
    """
    spark = docs.sparkSession
    out, n = shared_dir(spark), partitions(spark)
    rows = docs.select(F.coalesce(named(id_col).cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "key").sortWithinPartitions("key", F.xxhash64("text"))
    end = struct.pack("<H" if width == 2 else "<I", end_id)

    def write(batches):
        p, name = TaskContext.get().partitionId(), f"{out}/shards/{uuid.uuid4().hex}.bin"
        keys, lengths = [], []
        f, path = pafs.FileSystem.from_uri(name)
        f.create_dir(path.rpartition("/")[0], recursive=True)
        with f.open_output_stream(f"{path}.body") as body:
            for batch in batches:
                text, at = batch.column(1).to_pylist(), 0
                keys += batch.column(0).to_pylist()
                while at < len(text):
                    stop, size = at, 0
                    while stop < len(text) and size < 4_000_000:
                        size += len(text[stop])
                        stop += 1
                    for ids in encode(text[at:stop], tokenizer, width):
                        body.write(ids + end)
                        lengths.append(len(ids) // width + 1)
                    at = stop
        if keys:
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
            with f.open_output_stream(path) as done, f.open_input_stream(f"{path}.body") as body:
                done.write(struct.pack("<8sIQQ4x", SHARD_MAGIC, width, len(keys), int(ends[-1])))
                while part := body.read(8 << 20):
                    done.write(part)
                done.write(ends.tobytes())
        f.delete_file(f"{path}.body")
        if keys:
            k = np.array(keys, np.int64)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1])
            ends = np.concatenate([[0], np.cumsum(lengths)])
            stop = np.append(cut[1:], len(k))
            yield pa.record_batch([pa.array(k[cut]), pa.array(np.full(len(cut), p, np.int32)), pa.array([name] * len(cut)), pa.array(cut), pa.array(stop - cut), pa.array((ends[stop] - ends[cut]).astype(np.int64))], ["key", "shard", "file", "first", "count", "ids"])

    runs = materialise(spark, rows.mapInArrow(write, "key long, shard int, file string, first long, count long, ids long"))
    found = sorted(map(tuple, runs.groupBy("shard", "file").agg(F.sum("count"), F.sum("ids")).collect()))  # a row for each shard
    start, listed = 0, []
    for shard, file, records, ids in found:
        listed.append((shard, file, records, ids, start))
        start += ids
    shards = spark.createDataFrame(listed, "shard int, file string, records long, ids long, start long")
    buckets = max(1, -(-runs.count() // bucket_keys))
    keyed = runs.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).select("bucket", "key", "shard", "first", "count")
    keyed = keyed.repartition(min(buckets, n), "bucket").sortWithinPartitions("bucket")

    def index(batches):
        held: list[pa.RecordBatch] = []

        def done():
            t = pa.Table.from_batches(held)
            name = f"{out}/index/{uuid.uuid4().hex}.idx"
            write_file(name, iter([index_bytes(*(t.column(i).to_numpy() for i in range(1, 5)))]))
            return pa.record_batch([t.column(0)[:1].combine_chunks(), pa.array([name]), pa.array([t.num_rows], pa.int64())], ["bucket", "file", "keys"])

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column(0)[0].as_py() != int(bucket[a]):
                    yield done()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    return TokenStore(spark, shards, materialise(spark, keyed.mapInArrow(index, "bucket int, file string, keys long")), buckets)
