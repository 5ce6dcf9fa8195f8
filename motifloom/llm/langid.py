"""Language identification by compression.

Each language has a raw-content zstandard dictionary, cut from training texts.  A text is
compressed with every dictionary, in chunks, and the language whose dictionary makes it
smallest wins.  A narrow margin between the two smallest is a rejection.

The dictionaries are learnt from a bounded sample of labelled rows: per language at most
``dictionary_bytes`` bytes of at most SAMPLE_TEXTS different texts, taken in the order of a hash
of the text, and of each text at most ``text_share`` of the dictionary, from a place in the whole
text that another hash picks.  Predictions cover whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifloom.llm._text import slices

CHUNK = 2048
SAMPLE_TEXTS = 400  # different texts fetched per language, at most
LETTER = r"\p{L}"


class Languages:
    """Learnt dictionaries; small enough to travel with a task (languages x dictionary_bytes).

    ``names`` are in the order in which ties are settled.
    """

    def __init__(self, names: list[str], dictionaries: list[bytes]):
        self.names, self.dictionaries = names, dictionaries
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if self._ready is None:
            how = zstandard.ZstdCompressionParameters(
                window_log=18, chain_log=17, hash_log=17, search_log=5, min_match=3, target_length=64,
                strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            self._ready = []
            for d in self.dictionaries:
                ready = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                ready.precompute_compress(compression_params=how)
                self._ready.append(zstandard.ZstdCompressor(dict_data=ready, compression_params=how))
        return self._ready

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text with each language's dictionary."""
        data = plain(text)
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return np.array([sum(len(c.compress(x)) for x in chunks) for c in self._compressors()], dtype=np.int64)


def plain(text: str) -> bytes:
    """Lower case, single spaces: what is compared is spelling, not layout."""
    return b" ".join(text.lower().encode().split())


def learn_languages(docs: DataFrame, train: Column, dictionary_bytes: int = 96 << 10, text_share: float = 0.05, lang_col: str = "lang", text_col: str = "text") -> Languages:
    """Dictionaries of all languages found in the rows where ``train`` holds.

    Rows without a language, a text or a letter teach nothing.  Texts equal but for case and
    layout count once, however often they occur; SAMPLE_TEXTS of them are drawn evenly a language,
    or all if there are fewer.  A language's dictionary is never empty.  The table is read
    twice, for all languages together: to count and to fetch; again only for languages of which
    too few texts came.
    """
    lang, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    usable = docs.filter(train & lang.isNotNull() & text.rlike(LETTER)).select(lang.alias("lang"), text.alias("text"))
    spelt = F.trim(F.lower(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ")))
    rank = F.xxhash64("text", F.lit(7))
    hashed = usable.groupBy("lang", rank.alias("k")).agg(F.count("*").alias("n"))
    counts = {r["lang"]: (r["n"], r["texts"]) for r in hashed.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()}
    names = sorted(counts, key=lambda n: (-counts[n][0], n))
    most = max(1, int(dictionary_bytes * text_share))
    # an even share of the hash range that holds about twice as many texts as are needed
    share = {name: min(1.0, 2 * SAMPLE_TEXTS / counts[name][1]) for name in names}
    learnt: dict[str, bytes] = {}
    while missing := [name for name in names if name not in learnt]:
        bound = F.lit(None).cast("long")
        for name in missing:
            bound = F.when(F.col("lang") == name, F.lit(min(2**63 - 1, int(-(2**63) + share[name] * 2**64)))).otherwise(bound)
        drawn = usable.filter(rank <= bound).select("lang", rank.alias("k"), spelt.alias("t"))
        place = F.pmod(F.xxhash64("t", F.lit(11)), F.greatest(F.length("t") - most + 1, F.lit(1))).cast("int") + 1
        first = drawn.groupBy("lang", "t").agg(F.min("k").alias("k")).withColumn("cut", F.substring("t", place, F.lit(most)))
        order = Window.partitionBy("lang").orderBy("k", F.xxhash64("t"), "t")
        rows = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_TEXTS).select("lang", "n", "cut").collect()
        of: dict[str, list[tuple[int, str]]] = {}
        for r in rows:
            of.setdefault(r["lang"], []).append((r["n"], r["cut"]))
        for name in missing:
            size, parts = 0, []
            for x in dict.fromkeys(plain(cut) for _, cut in sorted(of.get(name, ()))):
                if x and size < dictionary_bytes:
                    parts.append(x[: min(most, dictionary_bytes - size)])
                    size += len(parts[-1]) + 1
            if size >= dictionary_bytes or len(of.get(name, ())) >= SAMPLE_TEXTS or share[name] == 1.0:
                learnt[name] = b" ".join(parts)
            share[name] = min(1.0, 4 * share[name])  # many of these are equal but for layout
    if empty := [name for name in names if not learnt[name]]:
        raise ValueError(f"no text was learnt for {empty}")
    return Languages(names, [learnt[name] for name in names])


def identify_language(docs: DataFrame, languages: Languages, min_margin: float = 0.002, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_rejected``.

    margin = 1 - smallest / second smallest; score = margin / (margin + min_margin), so 0.5 at the
    margin asked for.  A null text or one without a letter is ``und`` with score 0, and
    rejected; so is every text when nothing was learnt.  Ties go to the
    language with more training rows, with score 0.  Columns of the three names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    names = docs.columns
    model = docs.sparkSession.sparkContext.broadcast(languages)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for b in slices(batches, "__text", 1 << 22):
            pred, score = [], []
            for text, letters in zip(b.column("__text").to_pylist(), b.column("__letters").to_pylist(), strict=True):
                if not letters or not known.names:
                    pred.append("und")
                    score.append(0.0)
                    continue
                sizes = known.sizes(text)
                best = int(np.argmin(sizes))
                pred.append(known.names[best])
                margin = 1 - sizes[best] / np.partition(sizes, 1)[1] if len(sizes) > 1 else 1.0
                score.append(float(margin / (margin + min_margin)))
            rejected = [p == "und" or s < 0.5 for p, s in zip(pred, score, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(names))), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*names, "lang_pred", "lang_score", "lang_rejected"],
            )

    text = F.col(f"`{text_col}`")
    given = docs.select(*(F.col(f"`{c}`") for c in names), text.alias("__text"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("__letters"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string", "lang_score double", "lang_rejected boolean"])
    return given.mapInArrow(predict, schema)
