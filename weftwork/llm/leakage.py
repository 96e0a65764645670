"""Evaluation texts leaking into training text, by template canonicalisation.

Numbers, names and units become typed placeholders, word by word; windows of
template words are hashed and joined; the slots of joined windows are then
compared. Equal slots: the passage stands there verbatim. Slots that differ
by a consistent renaming: the item was re-parameterised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.session import durable

# Words for numbers (English, German, French, Spanish).
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen
null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig
zéro deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante soixante cent mille
cero dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien""".split()

# Words for units of measure, time and money.
UNIT_WORDS = """metre metres meter meters km kilometre kilometres kilometer kilometers mile miles yard yards foot feet inch inches league leagues
gram grams gramme grammes kg kilogram kilograms kilo kilos tonne tonnes ton tons pound pounds ounce ounces stone stones
litre litres liter liters gallon gallons pint pints second seconds minute minutes hour hours day days week weeks fortnight month months year years
dollar dollars cent cents euro euros percent degree degrees""".split()

#: Windows of items held against the documents in one pass, at 8 bytes each (128 MB); more are taken in blocks, by hash, a pass a block.
BLOCK_WINDOWS = 1 << 24
#: Names of the items that a worker can hold, at 8 bytes each. A larger item set is refused, not cut: give it in parts.
MOST_NAMES = 1 << 26
TOKEN = r"[^\p{L}\p{N}]+"
SEED = 7


def item_names(items: DataFrame, text: str) -> DataFrame:
    """(name, an unsigned hash as long): words that items write with a capital inside a sentence, all of them, each once."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?<=[\p{L}\p{N},;:] )(\p{Lu}[\p{L}\p{N}]+)"), F.lit(1)))
    said = items.where(F.col(text).isNotNull()).select(found.alias("name")).select(F.lower("name").alias("name")).distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_word_hash(batch.column(0), SEED).view(np.int64))], names=["name"])

    return said.mapInArrow(hashed, "name long")


def _sorted_hashes(df: DataFrame) -> np.ndarray:
    """The one column of ``df`` on the driver, as sorted unsigned numbers of 8 bytes."""
    return np.sort(df.toArrow().column(0).to_numpy().view(np.uint64))


def _word_hash(words: pa.Array, seed: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w or "", seed) for w in words.to_pylist()], dtype=np.uint64)


def _rolled(x: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of each ``width`` consecutive numbers."""
    out = np.zeros(max(0, len(x) - width + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + x[k : k + len(out)]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``held``."""
    if not len(held):
        return np.zeros(len(x), bool)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


class Templates:
    """Turns texts into template windows, a batch at a time, in Arrow and numpy."""

    def __init__(self, width: int, names, merge: bool, wanted=None):
        """``names`` and ``wanted`` (hashes of windows to keep, else all) are broadcast variables of sorted hashes."""
        self.width, self.merge, self.names, self.wanted = width, merge, names, wanted
        self.fixed = dict.fromkeys(UNIT_WORDS, 2) | dict.fromkeys(NUMBER_WORDS, 1)
        self.filter = None

    def _kept(self, rolled: np.ndarray) -> np.ndarray:
        """Which hashes are wanted: a bitmap of 32 bits a hash first, made once a worker, then a search."""
        wanted = self.wanted.value
        if self.filter is None:
            bits = max(16, int(len(wanted) * 32).bit_length())
            held = np.zeros(1 << bits >> 3, dtype=np.uint8)
            low = wanted & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(held, (low >> np.uint64(3)).astype(np.int64), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))
            self.filter = bits, held
        bits, held = self.filter
        low = rolled & np.uint64((1 << bits) - 1)
        ok = (held[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        ok[ok] = _among(rolled[ok], wanted)
        return ok

    def windows(self, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        """id, pos (of the first word), window (template hash), words, kinds; all windows, or the wanted ones."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern_regex(pc.utf8_lower(texts), TOKEN)
        owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        words = pc.list_flatten(lists)
        full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        words, owner = words.filter(pa.array(full)), owner[full]
        if not len(words):
            return self._batch(ids, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), [], [])
        coded = pc.dictionary_encode(words)
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        vocabulary, code = coded.dictionary, coded.indices.to_numpy()
        listed = vocabulary.to_pylist()
        hashed = _word_hash(vocabulary, SEED)
        kind = np.array([1 if w[0].isdigit() else self.fixed.get(w, 0) for w in listed], dtype=np.int8)
        kind[(kind == 0) & _among(hashed, self.names.value)] = 3
        for k in (1, 2, 3):
            hashed[kind == k] = np.uint64(k)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        pos = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
        kept = np.arange(len(code))
        if self.merge:  # a run of number words is one number
            number = kind[code] == 1
            inside = np.r_[False, number[1:] & number[:-1] & (owner[1:] == owner[:-1])]
            kept = kept[~inside]
        rolled = _rolled(hashed[code[kept]], self.width)
        own = owner[kept]
        ok = own[: len(rolled)] == own[self.width - 1 :] if len(rolled) else np.zeros(0, bool)
        if self.wanted is not None and len(rolled):
            ok = ok & self._kept(rolled)
        at = np.flatnonzero(ok)
        first = kept[at]
        after = np.r_[kept, len(code)][at + self.width]
        # a merged window ends before the next kept word of the same text
        after = np.minimum(after, np.r_[starts, len(code)][np.searchsorted(starts, first, "right")])
        said, types = [], []
        for i, (a, b) in enumerate(zip(first, after)):
            spans = np.r_[kept[at[i] : at[i] + self.width], b]
            said.append([" ".join(listed[c] for c in code[s:e]) for s, e in zip(spans[:-1], spans[1:])])
            types.append(kind[code[spans[:-1]]].astype(np.int32).tolist())
        return self._batch(ids, own[at], pos[first], rolled[at], said, types)

    @staticmethod
    def _batch(ids, owner, pos, rolled, said, types) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(owner, pa.int64())), pa.array(pos, pa.int64()), pa.array(rolled.view(np.int64)), pa.array(said, pa.list_(pa.string())), pa.array(types, pa.list_(pa.int32()))],
            names=["id", "pos", "window", "words", "kinds"],
        )


def template_windows(texts: DataFrame, key: str, text: str, templates: Templates) -> DataFrame:
    """(id, pos, window, words, kinds) of each text; null, empty and short texts have none. Nothing is cut off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                yield templates.windows(part.column(0), part.column(1))

    kind = texts.schema[key].dataType.simpleString()
    return texts.where(F.col(text).isNotNull()).select(F.col(key), F.col(text)).mapInArrow(run, f"id {kind}, pos long, window long, words array<string>, kinds array<int>")


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", width: int = 12, merge: bool = False, block: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, item_id, doc_pos, item_pos, kind, doc_words, item_words): windows of ``width`` template words in common.

    kind is ``verbatim`` (all words equal), ``reparameterised`` (only slots
    differ, and each item value stands for one document value and the other
    way round) or ``inconsistent`` (the same template, other slots at random).
    Words are unbroken runs of letters and digits, case ignored. With
    ``merge`` a run of number words is one slot, so numbers may differ in
    length. Replacement looks at one word at a time, so without ``merge`` no
    verbatim passage of ``width`` words is missed.

    The items' windows are held against all documents: their hashes, 8 bytes
    each, thin out the documents' windows inside the scan, then the two are
    joined on the hash and compared word by word. More than ``block`` of them
    go in blocks by hash, each a pass over the documents; a window is in one
    block, so blocks change nothing but the memory. Names are learned from the
    items, all of them.
    """
    context = documents.sparkSession.sparkContext
    known = durable(item_names(items, text), "p8-names")
    if (count := known.count()) > MOST_NAMES:
        raise ValueError(f"{count} names in the items, more than a worker can hold ({MOST_NAMES}); give the items in parts")
    names = context.broadcast(_sorted_hashes(known))
    of_items = durable(template_windows(items, item_key, text, Templates(width, names, merge)), "p8-items")
    hashes = of_items.select("window").distinct()
    blocks = max(1, -(-hashes.count() // block))
    met = None
    for k in range(blocks):
        mine = F.pmod(F.xxhash64("window"), F.lit(blocks)) == k
        wanted = context.broadcast(_sorted_hashes(hashes.where(mine)))
        of_docs = template_windows(documents, doc_key, text, Templates(width, names, merge, wanted))
        part = of_docs.select(F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), "window", F.col("words").alias("doc_words"), "kinds").join(
            of_items.where(mine).select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "window", F.col("words").alias("item_words"), F.col("kinds").alias("_k")), "window"
        )
        met = part if met is None else met.unionByName(part)
    met = met.where(F.col("kinds") == F.col("_k"))
    # the plain words must be equal; the hash alone is not trusted
    plain = F.forall(F.arrays_zip("kinds", "doc_words", "item_words"), lambda z: (z["kinds"] != 0) | (z["doc_words"] == z["item_words"]))
    slots = F.filter(F.arrays_zip("kinds", "doc_words", "item_words"), lambda z: z["kinds"] != 0)
    pairs = F.size(F.array_distinct(slots))
    one_to_one = (pairs == F.size(F.array_distinct(F.transform(slots, lambda z: F.struct(z["kinds"], z["doc_words"]))))) & (
        pairs == F.size(F.array_distinct(F.transform(slots, lambda z: F.struct(z["kinds"], z["item_words"]))))
    )
    kind = F.when(F.col("doc_words") == F.col("item_words"), "verbatim").when(one_to_one, "reparameterised").otherwise("inconsistent")
    return met.where(plain).select("doc_id", "item_id", "doc_pos", "item_pos", kind.alias("kind"), "doc_words", "item_words")
