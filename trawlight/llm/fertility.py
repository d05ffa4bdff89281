"""Quality rules from tokenizer fertility.

How well public vocabularies fit a text tells prose from noise: shouting, symbol litter and cell
separators need more tokens per character, fall back to bytes, or spread over other tokens than the prose
of their language does. Measures per document, each with rejection bands per language: characters per
token (two vocabularies), the share of byte-fallback tokens, and the entropy of the tokens against
the most their number allows. All of them depend on a text's length, so a language has one band per
doubling of the number of words; where these are few, the neighbouring lengths, the language or the
script stand in. A band is the median of its documents plus or minus ``WIDTH``
median absolute deviations: no constants per language, and the same at any size. A document is
rejected when a measure leaves its band.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from trawlight.llm.common import release_memory
from trawlight.session import materialise

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WIDTH = 8.0
LEAST_DOCS = 30
# First bytes of the two- to four-byte forms of each script's letters.
SCRIPTS = {"latin": (0xC3, 0xCC), "greek-cyrillic": (0xCD, 0xD4), "semitic": (0xD5, 0xDE), "indic": (0xE0, 0xE1), "east-asian": (0xE3, 0xED)}
# Deviations are not taken smaller than these, so uniform groups of copies do not close a band.
LEAST_DEVIATION = {"piece_chars": 0.01, "byte_chars": 0.01, "fallback": 0.01, "entropy": 0.01}
MEASURES = tuple(LEAST_DEVIATION)

_BLOCK_BYTES = 4 << 20
_KEPT_WORDS = 100_000
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_TYPES = {name: LongType() for name in (*_COUNTS, "size_class")} | {name: DoubleType() for name in MEASURES}
_TYPES |= {"base_failed": BooleanType(), "script": StringType()}
_ARROW = {name: pa.int64() if isinstance(kind, LongType) else pa.float64() for name, kind in _TYPES.items()}
_ARROW |= {"base_failed": pa.bool_(), "script": pa.string()}


class Vocabularies:
    """Token counts of single words: a vocabulary with byte fallback, and a byte-level one."""

    def __init__(self, piece_file: str, rank_file: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in open(rank_file, "rb"))}
        self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, tuple[bytes, int, int]] = {}

    def measure(self, words: list[str]) -> list[tuple[bytes, int, int]]:
        """Per word: its piece ids (unsigned 16-bit), how many are bytes, and its byte-level tokens."""
        if len(self.known) > _KEPT_WORDS:
            self.known.clear()
        new = [word for word in words if word not in self.known]
        for word, ids in zip(new, self.pieces.encode(new, num_threads=1) if new else []):
            found = np.array(ids, np.uint16)
            count = len(self.ranked.encode_ordinary(" " + word))
            self.known[word] = found.tobytes(), int(self.is_byte[found].sum()), count
        return [self.known[word] for word in words]


_loaded: dict[tuple[str, str, str], Vocabularies] = {}


def default_vocabularies() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def _vocabularies(files: tuple[str, str, str]) -> Vocabularies:
    if files not in _loaded:
        _loaded[files] = Vocabularies(*files)
    return _loaded[files]


def repeated_words(codes: np.ndarray) -> int:
    """How many words lie in a three-word window that stands in the text at least twice."""
    if len(codes) < 4:
        return 0
    windows = np.stack([codes[:-2], codes[1:-1], codes[2:]])
    order = np.lexsort(windows)
    ordered = windows[:, order]
    same = (ordered[:, 1:] == ordered[:, :-1]).all(0)
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, count = set(), 0
    if "\n" not in text:
        return 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            count += line in seen
            seen.add(line)
    return count


def _entropy(ids: np.ndarray) -> float:
    """Entropy of the tokens over the logarithm of their number; 0 for fewer than two."""
    if len(ids) < 2:
        return 0.0
    counts = np.unique(ids, return_counts=True)[1]
    return float((math.log2(len(ids)) - (counts * np.log2(counts)).sum() / len(ids)) / math.log2(len(ids)))


def _scripts_of(words: pa.Array) -> dict[str, np.ndarray]:
    """Letters of each script in each word, told by the first byte of their UTF-8 form."""
    if not len(words):
        return {name: np.zeros(0, np.int64) for name in SCRIPTS}
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    letters = (data | 0x20) - 0x61 < 26
    found = {}
    for name, (low, high) in SCRIPTS.items():
        inside = (data >= low) & (data <= high) | (letters if name == "latin" else False)
        ends = np.concatenate([[0], np.cumsum(inside)])
        found[name] = ends[offsets[1:]] - ends[offsets[:-1]]
    return found


def _measure_block(texts: pa.Array, vocabularies: Vocabularies) -> dict[str, np.ndarray]:
    words = pc.ascii_split_whitespace(texts)
    bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    dictionary = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    measured = vocabularies.measure(dictionary)
    word_chars = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    n_pieces = np.array([len(ids) // 2 for ids, _, _ in measured], np.int64)
    n_bytes = np.array([count for _, count, _ in measured], np.int64)
    n_ranked = np.array([count for _, _, count in measured], np.int64)
    empty = word_chars == 0
    for counts in (n_pieces, n_bytes, n_ranked):
        counts[empty] = 0
    starts = np.cumsum([0, *(len(ids) // 2 for ids, _, _ in measured)])[:-1]
    flat = np.frombuffer(b"".join(ids for ids, _, _ in measured), np.uint16)

    def sums(values: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(values[codes])])
        return ends[bounds[1:]] - ends[bounds[:-1]]

    scripts = _scripts_of(coded.dictionary)
    out = {f"script_{name}": sums(counts) for name, counts in scripts.items()}
    out |= {name: sums(values) for name, values in (("word_chars", word_chars), ("pieces", n_pieces))}
    out |= {"bytes": sums(n_bytes), "ranked": sums(n_ranked), "n_words": sums((~empty).astype(np.int64))}
    out["n_symbols"] = sum(
        pc.count_substring(texts, symbol).to_numpy(zero_copy_only=False).astype(np.int64) for symbol in SYMBOLS
    )
    out["n_dup_lines"] = np.array([duplicate_lines(text.as_py()) for text in texts], np.int64)
    repeats, entropy = [], []
    for a, b in zip(bounds, bounds[1:]):
        own = codes[a:b]
        own = own[~empty[own]]
        repeats.append(repeated_words(own))
        counts = n_pieces[own]
        ends = np.cumsum(counts)
        entropy.append(_entropy(flat[np.repeat(starts[own] - (ends - counts), counts) + np.arange(counts.sum())]))
    out["n_repeat_words"] = np.array(repeats, np.int64)
    chars = np.maximum(out["word_chars"], 1)
    out["piece_chars"] = np.log(chars / np.maximum(out["pieces"], 1))
    out["byte_chars"] = np.log(chars / np.maximum(out["ranked"], 1))
    out["fallback"] = out["bytes"] / np.maximum(out["pieces"], 1)
    out["entropy"] = np.array(entropy)
    names = list(SCRIPTS)
    most = np.argmax([out.pop(f"script_{name}") for name in names], axis=0)
    out["script"] = np.array(names, object)[most]
    return out


def measure_texts(texts: pa.Array, files: tuple[str, str, str]) -> dict[str, np.ndarray]:
    """Counts and measures of whole texts; a null text has no words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    parts, first = [], 0
    while first < len(texts):
        limit = (ends[first - 1] if first else 0) + _BLOCK_BYTES
        last = max(first + 1, int(np.searchsorted(ends, limit, side="right")))
        parts.append(_measure_block(texts.slice(first, last - first), _vocabularies(files)))
        first = last
    return {name: np.concatenate([part[name] for part in parts]) for name in parts[0]}


def failed_base(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (
        100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"]
    )


def with_measures(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """``docs`` with ``_tl_`` columns: counts, ``base_failed``, the measures and the length class."""
    files = files or default_vocabularies()
    names = docs.columns
    text = names.index("text")
    added = [*_COUNTS, "base_failed", *MEASURES, "size_class", "script"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = measure_texts(batch.column(text), files)
                found["base_failed"] = failed_base(found)
                found["size_class"] = np.frexp(found["n_words"])[1]
                columns = [*batch.columns, *(pa.array(found[name], _ARROW[name]) for name in added)]
                yield pa.RecordBatch.from_arrays(columns, [*names, *(f"_tl_{name}" for name in added)])
        _vocabularies(files).known.clear()  # the worker goes on to other stages
        release_memory()

    schema = StructType([*docs.schema, *(StructField(f"_tl_{name}", _TYPES[name]) for name in added)])
    return docs.mapInArrow(measure, schema)


def measures(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """``doc_id``, ``lang`` and the ``_tl_`` columns of ``with_measures``."""
    narrow = docs.select(docs["doc_id"].cast("long"), docs["lang"].cast("string"), docs["text"])
    return with_measures(narrow, files).drop("text")


def _pools(rows: DataFrame) -> DataFrame:
    """Each row once for every pool it belongs to: ``_tl_level`` and the keys of the pool.

    Levels, from narrow to wide: language and length class, the class with its two neighbours, the language,
    the script, all. A key that plays no part on a level is null; a null language is a language
    of its own, written as an empty array.
    """
    lang, own, script = F.array_compact(F.array("lang")), F.col("_tl_size_class"), F.col("_tl_script")
    none = F.lit(None)

    def pool(level: int, lang: Column, size: Column, script: Column) -> Column:
        return F.struct(
            F.lit(level).alias("_tl_level"),
            lang.cast("array<string>").alias("_tl_lang"),
            size.cast("bigint").alias("_tl_class"),
            script.cast("string").alias("_tl_in_script"),
        )

    near = [pool(1, lang, own + shift, none) for shift in (-1, 0, 1)]
    pools = F.array(pool(0, lang, own, none), *near, pool(2, lang, none, none), pool(3, none, none, script), pool(4, none, none, none))
    return rows.withColumn("_tl_pool", F.explode(pools)).select(*rows.columns, "_tl_pool.*")


_POOL = ["_tl_level", "_tl_lang", "_tl_class", "_tl_in_script"]


def bands(measured: DataFrame, width: float = WIDTH, least: int = LEAST_DOCS) -> DataFrame:
    """Lower and upper limits per language, length class and script, from all documents that pass the base rules.

    A cell with fewer than ``least`` documents takes the limits of the next wider pool that has as many:
    the length class with its neighbours, the language, the script, all documents. Medians and deviations
    are those of the pool, so neither a lone document nor the odd one of two sets its own limits. Medians are
    Spark's mergeable quantile sketches: a language of any size is summed up in its tasks.
    """
    good = measured.where(~F.col("_tl_base_failed")).select("lang", "_tl_size_class", "_tl_script", *[f"_tl_{m}" for m in MEASURES])
    pooled = _pools(good).drop("lang", "_tl_size_class", "_tl_script")
    middle = pooled.groupBy(*_POOL).agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.percentile_approx(f"_tl_{m}", 0.5, 10_000).alias(f"{m}_mid") for m in MEASURES],
    )
    middle = materialise(middle.withColumnsRenamed({name: f"{name}_of" for name in _POOL}), "medians")
    same = [F.col(name).eqNullSafe(F.col(f"{name}_of")) for name in _POOL]
    spread = pooled.join(middle, reduce(Column.__and__, same)).groupBy(*_POOL).agg(
        F.first("docs").alias("docs"),
        *[F.first(f"{m}_mid").alias(f"{m}_mid") for m in MEASURES],
        *[
            F.greatest(
                F.percentile_approx(F.abs(F.col(f"_tl_{m}") - F.col(f"{m}_mid")), 0.5, 10_000), F.lit(floor)
            ).alias(f"{m}_mad")
            for m, floor in LEAST_DEVIATION.items()
        ],
    )
    edges = []
    for m in MEASURES:
        edges.append((F.col(f"{m}_mid") - width * F.col(f"{m}_mad")).alias(f"_tl_{m}_low"))
        edges.append((F.col(f"{m}_mid") + width * F.col(f"{m}_mad")).alias(f"_tl_{m}_high"))
    limits = F.struct(*edges)
    spread = materialise(spread.select(*[F.col(name).alias(f"{name}_of") for name in _POOL], "docs", limits.alias("limits")), "pools")
    # Each cell meets its five pools; the narrowest that is large enough counts, all documents in any case.
    cells = good.select("lang", "_tl_size_class", "_tl_script").distinct()
    wanted = _pools(cells).where("_tl_level <> 1 OR _tl_class = _tl_size_class")
    choice = F.struct(((F.col("docs") < least) & (F.col("_tl_level") < 4)).alias("few"), "_tl_level")
    chosen = wanted.join(spread, reduce(Column.__and__, same)).groupBy(
        F.col("lang").alias("_tl_cell_lang"), F.col("_tl_size_class").alias("_tl_cell_class"), F.col("_tl_script").alias("_tl_cell_script")
    ).agg(F.min_by("limits", choice).alias("limits"))
    return chosen.select("_tl_cell_lang", "_tl_cell_class", "_tl_cell_script", "limits.*")


def _with_bands(measured: DataFrame, limits: DataFrame) -> DataFrame:
    same = (
        F.col("lang").eqNullSafe(F.col("_tl_cell_lang"))
        & (F.col("_tl_size_class") == F.col("_tl_cell_class"))
        & (F.col("_tl_script") == F.col("_tl_cell_script"))
    )
    return measured.join(limits, same, "left")


def _kept() -> Column:
    """True if no base rule failed and every measure lies in its band. High entropy is no fault."""
    kept = ~F.col("_tl_base_failed")
    for m in MEASURES:
        if m != "fallback":
            kept = kept & (F.col(f"_tl_{m}") >= F.col(f"_tl_{m}_low"))
        if m != "entropy":
            kept = kept & (F.col(f"_tl_{m}") <= F.col(f"_tl_{m}_high"))
    return F.coalesce(kept, F.lit(False))


def judge(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the measures of every row of ``docs``.

    Null, empty and blank texts have no words and fail the base rules. Repeated rows are judged one
    by one, alike. Rows without a language share their bands; an empty table stays empty.
    """
    measured = materialise(measures(docs, files), "measures")
    judged = _with_bands(measured, materialise(bands(measured), "bands"))
    own = [F.col(f"_tl_{name}").alias(name) for name in (*_COUNTS, "base_failed")]
    return judged.select("doc_id", *own, _kept().alias("kept"), "lang", *[F.col(f"_tl_{m}").alias(m) for m in MEASURES])


def keep_good(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns.

    Every text is measured once: the rows are stored with their measures, and the bands, a small
    table, are joined to them. Names of the input that start with ``_tl_`` are taken.
    """
    measured = materialise(with_measures(docs, files), "measured-documents")
    limits = materialise(bands(measured), "bands")
    return _with_bands(measured, limits).where(_kept()).select(*docs.columns)
