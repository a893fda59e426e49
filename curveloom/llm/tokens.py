"""Token identifiers of texts, flat token files, and the separator scan that counts their documents."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curveloom.llm.common import shared_folder, stored

#: Folder of the public tokenizer files; a parameter of all that use it.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: The one special token of the vocabulary (fixed values).
SPECIAL = {"<|endoftext|>": 50256}
#: The pre-tokenizer of the vocabulary (fixed value).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Most words whose identifiers a worker remembers.
REMEMBERED = 150_000
#: Identifiers in a block of a flat file.
BLOCK_IDS = 1 << 18


class Encoder:
    """Byte-pair encoding with a memory of words; ``encode`` gives little-endian 32-bit identifiers.

    The pre-tokenizer starts a new piece at a single space between two characters that are not white
    space, so a text may be cut there. Texts with other white space beside a space, or with a special
    token, are encoded whole.
    """

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> None:
        import tiktoken

        with open(f"{folder}/{vocabulary}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
        )
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, number in ranks.items():
            self.sizes[number] = len(piece)
        #: Identifiers of a space and the word.
        self.memory: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        first, *words = text.split(" ")
        if words and (not first or not _plain(first)):
            return self.whole(text)
        found = list(map(self.memory.get, words))
        if None in found:
            new = list(dict.fromkeys([w for w, ids in zip(words, found) if ids is None]))
            if not all(map(_plain, new)):
                return self.whole(text)
            learned = dict(zip(new, self._each(new)))
            found = [learned[w] if ids is None else ids for w, ids in zip(words, found)]
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            self.memory.update({w: ids for w, ids in learned.items() if len(w) <= 64})
        return self.whole(first) + b"".join(found)

    def _each(self, words: list[str]) -> list[bytes]:
        """The identifiers of a space and each word: all encoded at once, and cut by their lengths."""
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(words)), "<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = (4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]


def _plain(word: str) -> bool:
    """Whether spaces around the word are places to cut, and the word has no special token."""
    return bool(word) and not word[0].isspace() and not word[-1].isspace() and "<|" not in word


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str, vocabulary: str) -> Encoder:
    """The encoder of this worker process."""
    key = folder, vocabulary
    if key not in _encoders:
        _encoders[key] = Encoder(folder, vocabulary)
    return _encoders[key]


def write_flat_files(
    docs: DataFrame, end_id: int = SPECIAL["<|endoftext|>"], block_ids: int = BLOCK_IDS,
    folder: str = TOKENIZERS, vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """Tokenise whole texts into flat files: identifiers of all documents of a partition, one after
    another, each closed by ``end_id``; nothing marks where a document begins.

    Returns the stored ``blocks`` (file_id long, block_no long, ids binary: little-endian 16-bit, of
    ``block_ids`` identifiers but for the last of a file) and the stored ``order`` (file_id, doc_no
    long, doc_id) in which documents were written. A special token inside a text is encoded as
    ordinary text, so ``end_id`` ends documents only. Null texts count as empty.
    """
    kind = docs.schema["doc_id"].dataType
    if not 0 <= end_id < 1 << 16:
        raise ValueError("end_id must fit 16 bits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, encoding = encoder(folder, vocabulary).encode, encoder(folder, vocabulary).encoding
        file_id = TaskContext.get().partitionId()
        end = np.array([end_id], "<u2").tobytes()
        waiting, block_no, doc_no = bytearray(), 0, 0

        def rows(blocks: list[bytes], ids: pa.Array | None) -> pa.RecordBatch:
            nonlocal block_no, doc_no
            n, m = len(blocks), 0 if ids is None else len(ids)
            numbers = [*range(block_no, block_no + n), *range(doc_no, doc_no + m)]
            block_no, doc_no = block_no + n, doc_no + m
            return pa.RecordBatch.from_pydict({
                "file_id": pa.array([file_id] * (n + m), pa.int64()), "no": pa.array(numbers, pa.int64()),
                "ids": pa.array([*blocks, *[None] * m], pa.binary()),
                "doc_id": pa.concat_arrays([pa.nulls(n, ids.type), ids]) if m else pa.nulls(n, id_type),
                "is_block": pa.array([True] * n + [False] * m),
            })

        id_type = None
        size = 2 * block_ids
        for batch in batches:
            id_type = batch["doc_id"].type
            full: list[bytes] = []
            for value in batch["text"]:
                text = value.as_py() or ""
                if "<|endoftext|>" in text:
                    ids = np.array(encoding.encode_ordinary(text), "<u2").tobytes()
                else:
                    ids = np.frombuffer(encode(text), "<u4").astype("<u2").tobytes()
                waiting += ids + end
                while len(waiting) >= size:
                    full.append(bytes(waiting[:size]))
                    del waiting[:size]
            yield rows(full, batch["doc_id"])
        if waiting:
            yield rows([bytes(waiting)], None)

    written = docs.select("doc_id", "text").mapInArrow(
        write, f"file_id long, no long, ids binary, doc_id {kind.simpleString()}, is_block boolean"
    )
    path = shared_folder(docs.sparkSession)
    written.write.partitionBy("is_block").parquet(path)
    back = docs.sparkSession.read.schema(written.schema).parquet(path)
    return (
        back.where("is_block").select("file_id", F.col("no").alias("block_no"), "ids"),
        back.where("not is_block").select("file_id", F.col("no").alias("doc_no"), "doc_id"),
    )


def scan_separators(blocks: DataFrame, end_id: int) -> DataFrame:
    """(file_id, doc_no long, n_tokens long) of the documents in flat files, without the separators.

    Each block is searched alone, by one vector comparison: it gives the number of separators, the
    identifiers before the first and after the last, and the lengths between. A prefix scan over the
    summaries of a file, a few numbers for each block, numbers the documents and joins what crosses
    block borders, however many blocks a document spans. Identifiers after the last separator of a
    file are a document of their own if there are any. Empty blocks add nothing.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"ends": [], "head": [], "tail": [], "inner": []}
            for block in batch["ids"].to_pylist():
                ids = np.frombuffer(block or b"", "<u2")
                at = np.flatnonzero(ids == end_id)
                out["ends"].append(len(at))
                out["head"].append(int(at[0]) if len(at) else len(ids))
                out["tail"].append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                out["inner"].append(np.diff(at) - 1 if len(at) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_pydict({
                "file_id": batch["file_id"], "block_no": batch["block_no"],
                "ends": pa.array(out["ends"], pa.int64()), "head": pa.array(out["head"], pa.int64()),
                "tail": pa.array(out["tail"], pa.int64()), "inner": pa.array(out["inner"], pa.list_(pa.int64())),
            })

    found = stored(blocks.select("file_id", "block_no", "ids").mapInArrow(
        search, "file_id long, block_no long, ends long, head long, tail long, inner array<long>"
    ))
    order = Window.partitionBy("file_id").orderBy("block_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Identifiers since the last separator before this block: running length minus its value there.
    length = F.when(F.col("ends") == 0, F.col("tail")).otherwise(F.lit(0))
    summed = found.select(
        "file_id", "block_no", "ends", "head", "tail",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("doc_no"),
        F.sum(length).over(order).alias("run"),
    )
    carried = summed.select(
        "*",
        F.coalesce(
            F.lag("run").over(order)
            + F.coalesce(F.last(F.when(F.col("ends") > 0, F.col("tail") - F.col("run")), True).over(before), F.lit(0)),
            F.lit(0),
        ).alias("carry"),
        F.lead("block_no").over(order).isNull().alias("is_last"),
    )
    first = carried.where("ends > 0").select(
        "file_id", "doc_no", (F.col("carry") + F.col("head")).alias("n_tokens")
    )
    rest = carried.where("is_last").select(
        "file_id", (F.col("doc_no") + F.col("ends")).alias("doc_no"),
        F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("n_tokens"),
    ).where("n_tokens > 0")
    inner = found.where("ends > 1").join(
        carried.select("file_id", "block_no", "doc_no"), ["file_id", "block_no"]
    ).select("file_id", "doc_no", F.posexplode("inner").alias("at", "n_tokens")).select(
        "file_id", (F.col("doc_no") + F.col("at") + 1).alias("doc_no"), "n_tokens"
    )
    return first.unionByName(rest).unionByName(inner)


def token_counts(docs: DataFrame, **options: object) -> DataFrame:
    """(doc_id, n_tokens long) of every document, counted by scanning the flat files it is written to.

    Repeated rows are repeated documents; null and empty texts have 0 tokens.
    """
    end_id = options.get("end_id", SPECIAL["<|endoftext|>"])
    blocks, order = write_flat_files(docs, **options)
    return order.join(scan_separators(blocks, end_id), ["file_id", "doc_no"]).select("doc_id", "n_tokens")

