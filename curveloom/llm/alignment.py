"""Alignment of two tokenizers: token-byte incidence in compressed rows, links by row products, corpus-wide link counts."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveloom.llm.common import attach, map_batches, stored

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Most bytes of text whose incidence matrices are held at once, but for a group that is longer.
BLOCK_BYTES = 1 << 20
#: Most chunks of text whose identifiers a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 120_000, 64
#: Characters encoded at once, and texts worked on together.
SECTION, TEXTS = 1 << 20, 256
#: Linked id pairs that are broadcast; a larger table is joined by a shuffle, but for its frequent pairs.
BROADCAST_PAIRS = 400_000
#: Both tokenizers may be run on the parts between these places and give the same as on the whole: neither merges
#: across a single blank or line end between two characters that are not white space.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
TWO_BLANKS = re.compile(r"\s\s")


@dataclass
class Csr:
    """A matrix of zeros and ones by rows: row i has ones in ``indices[indptr[i]:indptr[i + 1]]``, in order."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    @classmethod
    def of_runs(cls, lengths: np.ndarray) -> "Csr":
        """Row i covers the ``lengths[i]`` columns after those of the rows before it."""
        indptr = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=indptr[1:])
        return cls(indptr, np.arange(indptr[-1]), int(indptr[-1]))

    def transposed(self) -> "Csr":
        order = np.argsort(self.indices, kind="stable")
        indptr = np.zeros(self.columns + 1, np.int64)
        np.cumsum(np.bincount(self.indices, minlength=self.columns), out=indptr[1:])
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        return Csr(indptr, rows[order], len(self.indptr) - 1)

    def rows(self, start: int, stop: int) -> "Csr":
        indptr = self.indptr[start:stop + 1]
        return Csr(indptr - indptr[0], self.indices[indptr[0]:indptr[-1]], self.columns)

    def product_terms(self, other: "Csr") -> np.ndarray:
        """Number of terms that each row of the product sums: its entries at most."""
        terms = np.zeros(len(self.indices) + 1, np.int64)
        np.cumsum(np.diff(other.indptr)[self.indices], out=terms[1:])
        return terms[self.indptr[1:]] - terms[self.indptr[:-1]]

    def times(self, other: "Csr") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of the product, row by row: a row sums the rows of ``other`` that its ones name."""
        widths = np.diff(other.indptr)[self.indices]
        rows = np.repeat(np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr)), widths)
        starts = other.indptr[self.indices] - (np.cumsum(widths) - widths)
        key = rows * other.columns + other.indices[np.repeat(starts, widths) + np.arange(len(rows))]
        if len(key) and (key[1:] < key[:-1]).any():
            key.sort(kind="stable")
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        value = np.diff(np.append(first, len(key)))
        return *np.divmod(key[first], max(1, other.columns)), value


@dataclass
class Alignment:
    """Tokens of both sides over the same bytes: groups between common ends, and overlap links."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    shared_bytes: np.ndarray

    @classmethod
    def of(cls, lengths_a: np.ndarray, lengths_b: np.ndarray) -> "Alignment":
        ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
        met = np.searchsorted(ends_b, ends_a)
        common_a = ends_b[met] == ends_a
        last_a, last_b = np.flatnonzero(common_a), met[common_a]
        group_a = np.searchsorted(last_a, np.arange(len(ends_a)))
        group_b = np.searchsorted(last_b, np.arange(len(ends_b)))
        found, at_a, at_b, at_byte = [], 0, 0, 0
        ends = ends_a[last_a]
        g = 0
        while g < len(ends):
            # Whole groups up to the size of a block: no token crosses its borders.
            g = max(g + 1, int(np.searchsorted(ends, at_byte + BLOCK_BYTES, "right")))
            to_a, to_b = last_a[g - 1] + 1, last_b[g - 1] + 1
            by_byte = Csr.of_runs(lengths_b[at_b:to_b]).transposed()
            a, b, n = Csr.of_runs(lengths_a[at_a:to_a]).times(by_byte)
            found.append((a + at_a, b + at_b, n))
            at_a, at_b, at_byte = to_a, to_b, int(ends[g - 1])
        empty = np.empty(0, np.int64)
        links = [np.concatenate(c) for c in zip(*found)] if found else [empty] * 3
        return cls(group_a, group_b, *links)

    def _by_group(self) -> tuple[Csr, Csr]:
        groups = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        a, b = (Csr(np.arange(len(g) + 1), g, groups) for g in (self.group_a, self.group_b))
        return a, b.transposed()

    def shared_counts(self) -> np.ndarray:
        """For each A token the number of B tokens in its group."""
        a, b = self._by_group()
        return a.product_terms(b)

    def shared_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(A token, B token) of the same group, in blocks of rows of the product of the group incidences."""
        a, b = self._by_group()
        terms = np.cumsum(a.product_terms(b))
        start, done = 0, 0
        while start < len(terms):
            stop = max(start + 1, int(np.searchsorted(terms, done + BLOCK_BYTES, "right")))
            rows, columns, _ = a.rows(start, stop).times(b)
            yield rows + start, columns
            start, done = stop, int(terms[stop - 1])


class Encoders:
    """Both tokenizers, with a memory of chunks; identifiers are little-endian 32-bit numbers."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        letters = _byte_letters()
        self.bytes_a = [b"".join(letters.get(c, c.encode()) for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.bytes_b = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        #: Each identifier as text with what may follow it: in a list, last of a list of A, last of a group.
        self.texts = [b"%d%s" % (i, mark) for n, marks in ((len(self.bytes_a), b",|"), (len(self.bytes_b), b",;"))
                      for mark in (marks[:1], marks[1:]) for i in range(n)]
        #: Identifiers by A and B of a word after a blank, of a word with its line end, or of a chunk with its blank.
        self.memory: dict[str, tuple[bytes, bytes]] = {}
        self.before: dict[str, tuple[bytes, bytes]] = {}

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Identifiers of a text that starts with a blank or a line end; None where the bytes are not its own."""
        a = self.a.encode(text, add_special_tokens=False).ids
        # B puts a blank before what it gets; before a line end that is one token too many.
        b = self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        data = text.encode()
        if any(b"".join(map(t.__getitem__, ids)) != data for t, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            return None
        return np.array(a, "<i4"), np.array(b, "<i4")

    def _learn(self, keys: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Identifiers of new chunks; those between places of ``CUT`` are encoded as one text and cut by their bytes."""
        chunks = [k if k[0] in " \n" else " " + k for k in keys]
        plain = [not c[1:2].isspace() and len(c) > 1 and not c[-1].isspace() for c in chunks]
        joined = [(k, c) for k, c, p in zip(keys, chunks, plain) if p]
        alone = [(k, c) for k, c, p in zip(keys, chunks, plain) if not p]
        out: dict[str, tuple[bytes, bytes] | None] = {}
        found = self._whole("".join([c for _, c in joined])) if joined else None
        if found is None:
            alone += joined
        else:
            ends = np.cumsum([len(c.encode()) for _, c in joined])
            sides = []
            for ids, sizes in zip(found, (self.size_a, self.size_b)):
                cuts = (4 * (np.searchsorted(np.cumsum(sizes[ids]), ends) + 1)).tolist()
                data = ids.tobytes()
                sides.append([data[i:j] for i, j in zip([0, *cuts], cuts)])
            out.update(zip([k for k, _ in joined], zip(*sides)))
        for key, chunk in alone:
            own = self._whole(chunk)
            out[key] = own and (own[0].tobytes(), own[1].tobytes())
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Identifiers of a blank and each text by A and by B; none for empty texts and where bytes of either differ."""
        out: list[list[tuple[bytes, bytes]] | None] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for section in _sections(" " + text) if text else ():
                waiting.append((i, _chunks(section)))
                size += len(section)
                if size >= 4 * SECTION:
                    self._encode(waiting, out)
                    waiting, size = [], 0
        self._encode(waiting, out)
        return [(b"".join([a for a, _ in parts]), b"".join([b for _, b in parts])) if parts else (b"", b"") for parts in out]

    def _encode(self, waiting: list[tuple[int, list[str]]], out: list[list[tuple[bytes, bytes]] | None]) -> None:
        known, before = self.memory, self.before
        found = [list(map(known.get, keys)) for _, keys in waiting]
        new = dict.fromkeys(k for (_, keys), f in zip(waiting, found) if None in f for k, e in zip(keys, f) if e is None)
        old = {k: e for k in new if (e := before.get(k)) is not None}
        learned = old | self._learn([k for k in new if k not in old])
        for (i, keys), f in zip(waiting, found):
            if None in f:
                f = [learned[k] if e is None else e for k, e in zip(keys, f)]
            if out[i] is not None:
                out[i] = None if None in f else out[i] + f
        if len(known) > REMEMBERED:
            # What is in use moves over from the memory before this one.
            self.memory, self.before = {}, known
        self.memory.update((k, e) for k, e in learned.items() if e is not None and len(k) <= LONGEST)


def _byte_letters() -> dict[str, bytes]:
    """The byte of each letter of a byte-level vocabulary: printable bytes are letters themselves, the others
    follow from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): bytes([b]) for b in plain} | {chr(256 + i): bytes([b]) for i, b in enumerate(others)}


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def _chunks(section: str) -> list[str]:
    """The parts of a section between the places of ``CUT``; without their blank if all of them are plain words."""
    if section[-1].isspace() or TWO_BLANKS.search(section):
        return CUT.split(section)
    return section.replace("\n", " \n").split(" ")[1:]


def _sections(text: str) -> Iterator[str]:
    """Parts of a text of about ``SECTION`` characters, cut at places of ``CUT``."""
    start = 0
    while len(text) - start > SECTION and (place := CUT.search(text, start + SECTION)):
        yield text[start:place.start()]
        start = place.start()
    yield text[start:]


def encoders(path_a: str, path_b: str) -> Encoders:
    """The tokenizers of this worker process, kept on an installed module: functions that travel by value have
    globals of their own in each task."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_kept_pairs", {})
    key = path_a, path_b
    if key not in kept:
        kept[key] = Encoders(path_a, path_b)
    return kept[key]


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _aligned(tools: Encoders, texts: list[str | None]) -> dict[str, list]:
    """What ``align_documents`` returns of some texts."""
    ids = tools.encode(texts)
    a, b = (np.frombuffer(b"".join([i[side] for i in ids]), "<i4") for side in (0, 1))
    cut_a, cut_b = (np.concatenate([[0], np.cumsum([len(i[side]) // 4 for i in ids])]) for side in (0, 1))
    found = Alignment.of(tools.size_a[a], tools.size_b[b])
    last_a = np.append(found.group_a[1:] != found.group_a[:-1], True)[: len(a)]
    last_b = np.append(found.group_b[1:] != found.group_b[:-1], True)[: len(b)]
    doc_of_a = np.repeat(np.arange(len(ids)), np.diff(cut_a))
    # In the text of a group its A tokens stand before its B tokens.
    to_b, to_a = np.flatnonzero(last_b) + 1, np.flatnonzero(last_a) + 1
    place_a = np.arange(len(a)) + np.concatenate([[0], to_b])[found.group_a]
    place_b = np.arange(len(b)) + to_a[found.group_b] if len(b) else np.empty(0, np.int64)
    of_text = np.empty(len(a) + len(b), np.int64)
    n_a, n_b = len(tools.bytes_a), len(tools.bytes_b)
    of_text[place_a] = a + n_a * last_a
    of_text[place_b] = b + 2 * n_a + n_b * last_b
    texts_of = map(tools.texts.__getitem__, of_text.tolist())
    groups = []
    for n in np.diff(cut_a + cut_b).tolist():
        groups.append(b"".join([t for _, t in zip(range(n), texts_of)])[:-1])

    doc_of_link = doc_of_a[found.link_a]
    cut_links = np.searchsorted(doc_of_link, np.arange(len(ids) + 1))
    key = (doc_of_link << 48) | (a[found.link_a].astype(np.int64) << 24) | b[found.link_b]
    pairs, times = np.unique(key, return_counts=True)
    cut_pairs = np.searchsorted(pairs, np.arange(len(ids) + 1) << 48)

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cut_pairs, pa.int32()), pa.array(values.astype(np.int32)))

    return {
        "n_a": np.diff(cut_a), "n_b": np.diff(cut_b), "n_groups": _sums(last_a, cut_a), "n_links": np.diff(cut_links),
        "n_shared": _sums(found.shared_counts(), cut_a) if len(a) else np.zeros(len(ids), np.int64), "groups": groups,
        "ids_a": lists((pairs >> 24) & 0xFFFFFF), "ids_b": lists(pairs & 0xFFFFFF), "times": lists(times),
    }


def align_documents(
    docs: DataFrame, with_groups: bool = False, path_a: str = "", path_b: str = "",
) -> DataFrame:
    """Tokens of a blank and each whole text by two tokenizers, linked where their bytes overlap.

    Returns doc_id, n_a, n_b (tokens), n_groups (parts between bytes where tokens of both end), n_links (pairs of
    tokens that overlap), n_shared (pairs of tokens in one group), groups_sha256, the linked identifiers ids_a, ids_b
    with the number of their links (times), and, if asked for, groups: ``a1,a2|b1;a3|b2``. A text that is null,
    empty or not what the tokens' bytes join to has no tokens: zeros, no lists and no hash. Paths default to
    the public vocabulary files. Other columns are not read; repeated rows give repeated rows.
    """
    paths = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        done = []
        for at in range(0, batch.num_rows, TEXTS):
            piece = batch.slice(at, TEXTS)
            found = _aligned(encoders(*paths), piece["text"].to_pylist())
            groups = found.pop("groups")
            hashes = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            columns = {"doc_id": piece["doc_id"], "groups_sha256": pa.array(hashes, pa.string())}
            if with_groups:
                columns["groups"] = pa.array([g.decode() for g in groups], pa.string())
            done.append(pa.RecordBatch.from_pydict(columns | {
                n: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for n, v in found.items()}))
        table = pa.Table.from_batches(done).combine_chunks()
        return {n: table[n].chunk(0) for n in table.column_names}

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]
    lists = ["ids_a", "ids_b", "times"]
    texts = ["groups_sha256", *["groups"] * with_groups]
    schema = ", ".join([f"doc_id {kind}", *[f"{n} string" for n in texts], *[f"{n} long" for n in numbers],
                        *[f"{n} array<int>" for n in lists]])
    return map_batches(docs, ["doc_id", "text"], run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(id_a, id_b, n_docs, is_best): documents that hold the pair linked; best of its A id, ties included."""
    held = aligned.select(F.inline(F.arrays_zip("ids_a", "ids_b"))).groupBy("ids_a", "ids_b").agg(
        F.count(F.lit(1)).alias("n_docs"))
    counts = stored(held)
    most = counts.groupBy("ids_a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "ids_a").select(
        F.col("ids_a").alias("id_a"), F.col("ids_b").alias("id_b"), "n_docs",
        (F.col("n_docs") == F.col("most")).alias("is_best"))


def link_support(docs: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS, **options: str) -> DataFrame:
    """``align_documents`` without its lists, with n_best and count_sum of each document.

    n_best counts the links whose corpus-wide count is the highest of their A id, count_sum sums the counts over
    all links. The counts are broadcast while there are few; beyond that the links of a document are joined with
    them by a shuffle, frequent pairs by broadcast.
    """
    aligned = stored(align_documents(docs, **options).withColumn("row", F.monotonically_increasing_id()))
    counts = stored(link_counts(aligned))
    links = aligned.select("row", F.inline(F.arrays_zip("ids_a", "ids_b", "times"))).select(
        "row", F.col("ids_a").alias("id_a"), F.col("ids_b").alias("id_b"), "times")
    if counts.count() <= broadcast_pairs:
        met = links.join(F.broadcast(counts), ["id_a", "id_b"])
    else:
        met = attach(links, counts.withColumn("weight", F.col("n_docs")), ["id_a", "id_b"], "weight")
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times"))).alias("n_best"),
        F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.drop("ids_a", "ids_b", "times").join(sums, "row", "left").select(
        *[c for c in aligned.columns if c not in ("ids_a", "ids_b", "times", "row")],
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))
