"""Quality rules: base counts, and the divergence of a document from language references."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curveloom.llm.common import PIECE_ROWS, map_batches, text_bytes

#: Characters counted as symbols (fixed value).
SYMBOLS = b"#*$%&|<>"
#: Common words of a language: its most frequent words of at most so many code points.
COMMON, COMMON_LENGTH = 96, 8
#: Counts a task gathers before it hands them on.
HELD_COUNTS = 200_000
#: Guards: shorter documents are not compared.
LEAST_CHARS, LEAST_WORDS = 200, 100
#: Largest Jensen-Shannon distances (root of the divergence in bits) to the nearest reference.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.5

#: Classes of code points: of ASCII vowel, other lower-case, upper-case, digit, blank, sentence mark, symbol, other;
#: of the rest lower-case, upper-case, letter without case, mark, number, other.
CLASSES = 14
IS_LETTER = np.isin(np.arange(CLASSES), (0, 1, 2, 8, 9, 10))
#: Scripts are told apart by blocks of so many code points.
SCRIPT_BLOCK = 128
#: Blocks from here on are one script (ideographs, kana and syllables of East Asia); blocks below 0x250 are Latin.
EAST_ASIA, LATIN_END = 0x2E80, 0x250


def _ascii_class(letter: str) -> int:
    if letter in "aeiouy":
        return 0
    if letter.islower():
        return 1
    if letter.isupper():
        return 2
    if letter.isdigit():
        return 3
    if letter in " \t\n\x0b\x0c\r":
        return 4
    if letter in ".,;:!?'\"()-":
        return 5
    return 6 if letter in "#*$%&|<>{}[]\\/=+@~^_`" else 7


def _wide_class(letter: str) -> int:
    category = unicodedata.category(letter)
    if category in ("Ll", "Lu", "Lt"):
        return 8 if category == "Ll" else 9
    return {"L": 10, "M": 11, "N": 12}.get(category[0], 13)


@cache
def code_classes() -> np.ndarray:
    """The class of every code point, worked out once a worker."""
    return np.array([_ascii_class(chr(c)) for c in range(128)] + [_wide_class(chr(c)) for c in range(128, 0x110000)], np.uint8)


def code_points(text: bytes) -> np.ndarray:
    """Code points of a text in UTF-8."""
    if text.isascii():
        return np.frombuffer(text, np.uint8)
    return np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)


def class_histogram(text: bytes) -> np.ndarray:
    return np.bincount(code_classes()[code_points(text)], minlength=CLASSES)


def script(text: bytes) -> int | None:
    """The script of most letters of a text: -1 Latin, -2 East Asian, else the number of the block of
    code points they are in; None without letters."""
    points = code_points(text)
    letters = points[IS_LETTER[code_classes()[points]]]
    if not len(letters):
        return None
    if text.isascii():
        return -1
    blocks, counts = np.unique(np.where(letters < LATIN_END, -1, np.where(
        letters >= EAST_ASIA, -2, letters.astype(np.int64) // SCRIPT_BLOCK)), return_counts=True)
    return int(blocks[counts.argmax()])


def short_words(words: list[bytes]) -> list[bytes]:
    """Words without marks at their ends, A-Z lower-cased, as far as they are short enough to be common."""
    bare = (w.strip(b".,;:!?'\"()").lower() for w in words if len(w) <= 4 * COMMON_LENGTH + 2)
    return [w for w in bare if w and (len(w) <= COMMON_LENGTH or not w.isascii() and len(w.decode("utf-8")) <= COMMON_LENGTH)]


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - _continuations(text)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    duplicates = 0
    for line in text.split(b"\n"):
        if line in seen:
            duplicates += 1
        elif line and not line.isspace():
            seen.add(line)
    repeated = 0
    if n > 3:
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * np.int64(len(numbers)) + ids[2:]
        _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
        again = count[place] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift:shift + n - 2] |= again
        repeated = int(covered.sum())
    return n, chars, symbols, duplicates, repeated


def _continuations(text: bytes) -> int:
    values = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((values & 0xC0) == 0x80))


@dataclass
class Reference:
    """Histograms of a language over all its documents, and the script most of these are in."""

    lang: str
    script: int | None
    classes: np.ndarray
    words: dict[bytes, int]
    word_shares: np.ndarray


def references(docs: DataFrame) -> list[Reference]:
    """References of all languages from all labelled texts of ``docs`` (text, lang).

    Counts are gathered over a task's batches, handed on at ``HELD_COUNTS`` of them, and summed before and after the
    shuffle; a few numbers and ``COMMON`` words a language reach the driver. Every language has a reference,
    however few documents it has; an empty table has none.
    """
    def rows_of(held: Counter) -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.binary()))]
            + [pa.array([held[k] for k in keys], pa.int64())], ["lang", "part", "item", "n"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(at, PIECE_ROWS)
                words: dict[str, Counter] = {}
                for text, lang in zip(text_bytes(piece["text"]), piece["lang"].to_pylist()):
                    if not text:
                        continue
                    split = text.split()
                    words.setdefault(lang, Counter()).update(short_words(split))
                    held[lang, "word", None] += len(split)
                    for i, n in enumerate(class_histogram(text)):
                        if n:
                            held[lang, "class", b"%d" % i] += int(n)
                    if (letters := script(text)) is not None:
                        held[lang, "script", b"%d" % letters] += 1
                for lang, counted in words.items():
                    for word, n in counted.items():
                        held[lang, "word", word] += n
                if len(held) > HELD_COUNTS:
                    yield rows_of(held)
                    held.clear()
        yield rows_of(held)

    counted = docs.where("lang is not null").select("text", "lang").mapInArrow(
        over, "lang string, part string, item binary, n long")
    summed = counted.groupBy("lang", "part", "item").agg(F.sum("n").alias("n"))
    common = Window.partitionBy("lang", "part").orderBy(
        F.col("item").isNull().desc(), F.col("n").desc(), "item")
    top = summed.withColumn("place", F.row_number().over(common)).where(F.col("place") <= COMMON + 1)
    by_lang: dict[str, dict[str, list]] = {}
    for row in top.orderBy("lang", "part", "place").collect():
        by_lang.setdefault(row["lang"], {}).setdefault(row["part"], []).append(
            (None if row["item"] is None else bytes(row["item"]), row["n"]))
    found = []
    for lang, parts in by_lang.items():
        classes = np.zeros(CLASSES)
        for item, n in parts.get("class", []):
            classes[int(item)] = n
        all_words = parts["word"][0][1]
        common_words = [(w, n) for w, n in parts["word"] if w is not None][:COMMON]
        shares = np.array([n for _, n in common_words] + [all_words - sum(n for _, n in common_words)], float)
        if classes.sum() and all_words:
            letters = int(parts["script"][0][0]) if "script" in parts else None
            found.append(Reference(lang, letters, classes / classes.sum(), {w: i for i, (w, _) in enumerate(common_words)},
                                   shares / shares.sum()))
    return found


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two shares, from 0 to 1."""
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / middle), 0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(parts) / 2)))


def comparable(text: bytes, lang: str | None, known: list[Reference]) -> list[Reference]:
    """References a text may be held against: its own language's and those of its script. A text
    without letters is in no script, so no rare one either, and is held against all."""
    letters = script(text)
    return [r for r in known if letters is None or r.lang == lang or r.script == letters]


def distances(text: bytes, known: list[Reference]) -> tuple[float, float]:
    """Distance of classes and of common words to the nearest reference of each."""
    classes = class_histogram(text)
    words = text.split()
    short = Counter(short_words(words))
    of_classes, of_words = 1.0, 1.0
    for reference in known:
        of_classes = min(of_classes, distance(classes / classes.sum(), reference.classes))
        found = np.zeros(len(reference.words) + 1)
        for word, at in reference.words.items():
            found[at] = short.get(word, 0)
        found[-1] = len(words) - found.sum()
        of_words = min(of_words, distance(found / len(words), reference.word_shares))
    return of_classes, of_words


def judge(docs: DataFrame, known: list[Reference], most_class: float = MOST_CLASS_DISTANCE,
          most_word: float = MOST_WORD_DISTANCE) -> DataFrame:
    """Base counts, base_failed, class_distance, word_distance and kept of every whole text.

    A document that passes the base rules goes if it is long enough for a comparison and is farther
    from every reference of its own language or script than allowed, in classes or in common words. Distances
    are null, and the document stays, where nothing was compared: short texts, or no such reference. Null texts
    count as empty, repeated rows are judged alike, an empty table gives no rows. A text of any length is
    counted whole; the largest arrays are of eight bytes a word and four a code point.
    """
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        counts, failed, of_classes, of_words, kept = [], [], [], [], []
        for text, lang in zip(text_bytes(batch["text"]), batch["lang"].to_pylist()):
            found = base_counts(text)
            counts.append(found)
            failed.append(found[0] < 50 or 100 * found[4] > 50 * found[0])
            long_enough = text is not None and found[1] >= LEAST_CHARS and found[0] >= LEAST_WORDS
            against = comparable(text, lang, known) if long_enough else []
            near = distances(text, against) if against else (None, None)
            of_classes.append(near[0])
            of_words.append(near[1])
            kept.append(not failed[-1] and not (against and (near[0] > most_class or near[1] > most_word)))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return {"doc_id": batch["doc_id"], **{n: pa.array([c[i] for c in counts], pa.int64()) for i, n in enumerate(names)},
                "base_failed": pa.array(failed, pa.bool_()), "kept": pa.array(kept, pa.bool_()),
                "class_distance": pa.array(of_classes, pa.float64()), "word_distance": pa.array(of_words, pa.float64())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, ["doc_id", "text", "lang"], run,
                       f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                       "n_repeat_words long, base_failed boolean, kept boolean, class_distance double, "
                       "word_distance double")


def quality(docs: DataFrame) -> DataFrame:
    """All documents judged against the references of their own table."""
    return judge(docs, references(docs.select("text", "lang")))
