"""Benchmark decontamination by canonical templates.

Words lose marks at their ends and capitals; numbers, units and names become typed placeholders.
Template windows of an item and of a document that are equal meet by hash; the values behind their
placeholders must correspond one to one over all windows of an alignment, which is what a
re-parameterised question keeps. A capitalised word that opens a text, a line or a sentence is taken
as a name and as a plain word, on both sides. Names that follow one another are one placeholder. Windows of literal words catch plain copies, whose first word, for
one, may pass for a name. A bit filter of fixed size over the items' windows spares the shuffle
of windows that no item has; the join is exact at any size of either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm import sketch
from trawl.llm.common import _LOWER, U64, Powers, byte_codes, mixed, pieces, spread, staged, words_of
from trawl.llm.quality import _CAPITAL, _DIGIT, _LETTER

LITERAL = 8  # words of a literal window
TEMPLATE = 10  # words of a template window
PLAIN = 5  # words that are no placeholders and agree in a template alignment, at least; all of an item that has fewer
FILTER_BITS = 24
# fixed values: words that count as units or numbers
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees mph kmh watt watts volt volts "
    "zentimeter kilometern metern gramm kilogramm tonne tonnen pfund sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate jahr jahre jahren prozent grad "
    "mètre mètres kilomètre kilomètres gramme grammes tonnes secondes heure heures jour jours semaine semaines mois ans année années degrés "
    "metro metros kilómetro kilómetros gramo gramos litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grados"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million half dozen "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze quinze vingt trente quarante cinquante soixante mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil"
).split()
_INSIDE_NUMBER = _DIGIT.copy()
_INSIDE_NUMBER[list(b".,:/-%$")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\"'()")] = True
NUMBER, UNIT, NAME = U64(0xA1), U64(0xB2), U64(0xC3)


def _hash_of(words: list[str], powers: Powers) -> np.ndarray:
    blob = [w.encode() for w in words]
    off = np.cumsum([0] + [len(b) for b in blob])
    data = np.frombuffer(b"".join(blob), np.uint8)
    return np.sort(powers.ranges(powers.prefix(byte_codes(0)[_LOWER][data]), off[:-1], off[1:], 41))


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def canonical(data: np.ndarray, off: np.ndarray, powers: Powers):
    """(literal, first) of all words; (literal, template, opens, first, word) of all units.

    literal is a hash, that of a unit with a placeholder is its type in template. Names that
    follow one another in a sentence are one unit, any other word is one. An opening word that
    may be a name has its literal hash as template hash, and opens set. word is the place of a
    unit's first word, with the number of words at its end.
    """
    starts, ends, first = words_of(data, off)
    if not len(starts):
        none = np.zeros(0, U64)
        return (none, first), (none, none, np.zeros(0, bool), first, np.zeros(1, np.int64))
    solid = np.flatnonzero(_LETTER[data] | _DIGIT[data])
    solid = np.append(solid, len(data))
    lo = solid[np.searchsorted(solid, starts)]
    hi = solid[np.maximum(np.searchsorted(solid, ends) - 1, 0)] + 1
    bare = (lo >= ends) | (hi <= lo)
    lo, hi = np.where(bare, starts, lo), np.where(bare, ends, hi)
    prefix = powers.prefix(byte_codes(0)[_LOWER][data])
    literal = powers.ranges(prefix, lo, hi, 41)
    total = lambda t: np.concatenate([[0], np.cumsum(t)])
    # a capital is A to Z, or the two bytes of U+00C0 to U+00DE
    after = np.append(data[1:], 0)
    capital = _CAPITAL[data] | ((data == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97))
    digits, inside, capitals = total(_DIGIT[data]), total(_INSIDE_NUMBER[data]), total(capital)
    number = (digits[hi] > digits[lo]) & (inside[hi] - inside[lo] == hi - lo) | _among(literal, _hash_of(NUMBERS, powers))
    unit = _among(literal, _hash_of(UNITS, powers))
    # a name: one leading capital; where a sentence, a line or a text begins it may be one or not
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    begins = np.ones(len(starts), bool)
    begins[1:] = _STOP[data[ends[:-1] - 1]] | (breaks[starts[1:]] > breaks[ends[:-1]])
    at = first[:-1]
    begins[at[at < len(starts)]] = True
    named = capital[lo] & (capitals[hi] - capitals[lo] == 1) & (hi - lo > 1) & ~number & ~unit
    sure = named & ~begins
    # a name goes on where no mark stands between
    goes_on = np.zeros(len(starts), bool)
    goes_on[1:] = sure[1:] & sure[:-1] & (hi[:-1] == ends[:-1]) & (lo[1:] == starts[1:])
    word = np.flatnonzero(~goes_on)
    last = np.append(word[1:], len(starts)) - 1
    of_unit = np.where(last > word, powers.ranges(prefix, lo[word], hi[last], 41), literal[word])
    template = np.where(number, NUMBER, np.where(unit & ~number, UNIT, np.where(sure, NAME, literal)))[word]
    return (literal, first), (of_unit, template, (named & begins)[word], np.searchsorted(word, first), np.append(word, len(starts)))


def windows(data: np.ndarray, off: np.ndarray, powers: Powers, kinds, short: bool = False, bits: np.ndarray | None = None, bare: bool | None = None):
    """Pieces (owner, start, width, kind, hash, slot bounds, slots, loose, plain bits, words, plain words, first word, words of it) of windows of ``kinds``.

    ``kinds`` are (0, width) of literal and (1, width) of template windows. A literal window
    counts words, a template window units (see ``canonical``). A template window has a
    placeholder; its slots are the literal hashes behind its placeholders. It comes once for every
    reading of its opening capitalised words as names or not; loose tells the slots of those read
    as names. Plain bits are the places of its other units, plain words those of the text that are
    plain in any reading. With ``short``, a text of fewer units than a width is one window. With
    ``bits``, only windows that may be in them come; with ``bare``, only template windows without
    (True) or with (False) a plain word, and literal ones with False.
    """
    (literal, first), (of_unit, template, opens, unit_first, word) = canonical(data, off, powers)
    words = np.diff(first)
    total = lambda t: np.concatenate([[0], np.cumsum(t)])
    placed = template != of_unit
    slots_to, opens_to, openers = total(placed), total(opens), np.flatnonzero(opens)
    turned = NAME - of_unit[openers]
    certain = np.diff(total(~placed & ~opens)[unit_first])
    for kind, width in kinds:
        code, value, at_first = (template, of_unit, unit_first) if kind else (literal, literal, first)
        n = np.diff(at_first)
        size = np.full(len(n), width)
        if short:
            size = np.minimum(size, np.maximum(n, 1))
        count = np.maximum(n - size + 1, 0) * (n > 0)
        owner_of = np.repeat(np.arange(len(n)), count)
        start = np.repeat(at_first[:-1], count) + spread(count)
        if not len(start):
            continue
        prefix, end = powers.prefix(code), start + size[owner_of]
        plain_hash = (prefix[end] - prefix[start]) * powers.down[start] + size[owner_of].astype(U64)
        fixed, some = (slots_to[end] - slots_to[start], opens_to[end] - opens_to[start]) if kind else (np.zeros(len(start), np.int64),) * 2
        for m in range(1 << int(some.max())):
            if m & (m - 1) == 0:  # one more opening word than before
                at = np.flatnonzero(some >= m.bit_length())
            p, w, slots = start[at], size[owner_of[at]], fixed[at] + m.bit_count()
            h, names = plain_hash[at], np.zeros(len(at), np.int64)
            for j in range(m.bit_length()):
                if m >> j & 1:
                    nth = opens_to[p] + j
                    h = h + turned[nth] * powers.up[openers[nth] - p]
                    names |= 1 << (openers[nth] - p)
            h = mixed(h, 43 + kind)
            keep = slots > 0 if kind else np.full(len(p), bare is not True)
            if kind and bare is not None:
                keep &= (slots == w) == bare
            if bits is not None:
                keep &= sketch.may_repeat(bits, h)
            keep = np.flatnonzero(keep)
            if not len(keep):
                continue
            p, w, h, names, owner = p[keep], w[keep], h[keep], names[keep], owner_of[at[keep]]
            cell = p[:, None] + np.arange(width)
            loose = (names[:, None] >> np.arange(width)) & 1 > 0
            inside = cell < (p + w)[:, None]
            slot = (placed[np.minimum(cell, len(placed) - 1)] | loose) & inside & bool(kind)
            plain = (inside & ~slot) @ (1 << np.arange(width))
            begin, finish = (word[p], word[p + w]) if kind else (p, p + w)
            yield (
                owner, p - at_first[owner], w, np.full(len(p), kind), h, total(slot.sum(1)), value[cell[slot]], loose[slot], plain, words[owner], certain[owner],
                begin - first[owner], finish - begin,
            )


def _window_rows(df: DataFrame, key: str, kinds, short: bool = False, bits=None, bare: bool | None = None) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def rows(batches):
        powers = Powers()
        for part, data, off in pieces(batches):
            for owner, start, width, what, h, bound, values, loose, plain, n, certain, word, width_words in windows(data, off, powers, kinds, short, bits and bits.value, bare):
                pick, bound = pa.array(owner), pa.array(bound.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).take(pick), part.column("text_key").take(pick), pa.array(start.astype(np.int32)), pa.array(width.astype(np.int32)),
                        pa.array(what.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(bound, pa.array(values.view(np.int64))), pa.ListArray.from_arrays(bound, pa.array(loose)),
                        pa.array(plain.astype(np.int32)), pa.array(certain.astype(np.int32)), pa.array(word.astype(np.int32)), pa.array(width_words.astype(np.int32)),
                    ],
                    names=[key, "text_key", "start", "width", "kind", "hash", "words", "slots", "loose", "plain", "certain", "word", "width_words"],
                )

    return df.select(key, "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        rows, f"{key} {kind}, text_key long, start int, width int, kind int, hash long, words int, slots array<long>, loose array<boolean>, plain int, certain int, word int, width_words int"
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, item_words, covered_words, reparameterised): documents that hold item windows.

    Only alignments whose slots correspond one to one count. Windows where an opening word as a
    name contradicts other slots are left out; if certain slots contradict each other then, the
    windows without opening words as names decide. reparameterised says that an
    alignment of the pair's templates has other values than the item. Null and empty texts and items
    match nothing; an item of fewer words than a window matches as a whole. An alignment of templates needs PLAIN
    equal plain words, or all of an item's that has fewer, and one at least; repeated rows give one
    pair; rows with null ids keep the null. text_key is xxhash64 of the text. Only the ids and
    texts are read, so other columns may have any name.
    """
    full = [(0, LITERAL), (1, TEMPLATE)]
    items = staged(
        _window_rows(benchmark.where("text IS NOT NULL"), "item_id", full, short=True)
        .select(
            "item_id", "hash", "kind", F.col("start").alias("at"), F.col("width").alias("item_width"), F.col("words").alias("item_words"),
            F.col("slots").alias("item_slots"), F.col("loose").alias("item_loose"), "plain", "certain", "word", "width_words",
        )
        .dropDuplicates(["item_id", "hash", "kind", "at", "item_loose", "item_slots"]),
        "items",
    )

    def hashes(batches):
        for b in batches:
            yield b.column(0).to_numpy().view(U64)

    spark = docs.sparkSession
    kinds = sorted({(r.kind, r.item_width) for r in items.select("kind", "item_width").distinct().collect()} | set(full))  # LITERAL + TEMPLATE at most
    bits = spark.sparkContext.broadcast(sketch.repeated(items.select("hash"), hashes, FILTER_BITS, least=1))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    cols = ["doc_id", "text_key", "hash", "kind", "start", "slots", "loose"]
    # an alignment needs a plain word, so windows without one, which many texts share, meet only in alignments that others find
    bare = (F.col("kind") == 1) & (F.col("plain") == 0)
    met = _window_rows(texts, "doc_id", kinds, bits=bits, bare=False).select(*cols)
    hits = met.join(items.where(~bare), ["hash", "kind"])
    lone = items.where(bare)
    if lone.limit(1).count():
        hits = staged(hits, "hits")
        found = hits.where("kind = 1").select("doc_id", "text_key", "item_id", (F.col("start") - F.col("at")).alias("shift")).distinct()
        place = found.join(lone, "item_id").withColumn("start", (F.col("shift") + F.col("at")).cast("int")).drop("shift").withColumnRenamed("doc_id", "_doc")
        more = _window_rows(texts, "doc_id", kinds, bits=bits, bare=True).select(*cols)
        same_place = more["doc_id"].eqNullSafe(place["_doc"])
        hits = hits.unionByName(more.join(place, ["text_key", "start", "hash", "kind"]).where(same_place).drop("_doc"))
    pair = lambda x: F.struct(x["item_slots"].alias("a"), x["slots"].alias("b"), (x["item_loose"] | x["loose"]).alias("loose"))
    zipped = F.arrays_zip("item_slots", "slots", "item_loose", "loose")
    # the same opening word on both sides meets literally too, and then binds nothing
    hits = hits.where(~F.exists(zipped, lambda x: (x["item_slots"] == x["slots"]) & x["item_loose"] & x["loose"]))
    hits = hits.withColumn("hit", F.struct(F.transform(zipped, pair).alias("pairs"), "at", "plain", "word", "width_words"))
    at = ["doc_id", "text_key", "item_id", "item_words", "certain", "kind", (F.col("start") - F.col("at")).alias("shift")]
    pairs = lambda x: F.array_distinct(F.flatten(F.transform(x, lambda h: h["pairs"])))
    clash = lambda x, y: (x["a"] == y["a"]) != (x["b"] == y["b"])
    apart = lambda ps: ~F.exists(ps, lambda x: F.exists(ps, lambda y: clash(x, y)))
    places = F.sequence(F.lit(0), F.lit(TEMPLATE - 1))
    plain_at = lambda h: F.transform(F.filter(places, lambda j: F.getbit(h["plain"], j) == 1), lambda j: h["at"] + j)
    one = (
        hits.groupBy(*at)
        .agg(F.collect_set("hit").alias("hits"))
        .withColumn("pairs", pairs(F.col("hits")))
        .withColumn("wrong", F.filter("pairs", lambda x: x["loose"] & F.exists("pairs", lambda y: clash(x, y))))
        .withColumn("kept", F.filter("hits", lambda h: ~F.arrays_overlap(h["pairs"], F.col("wrong"))))
        .withColumn("strict", F.filter("hits", lambda h: ~F.exists(h["pairs"], lambda x: x["loose"])))
        .withColumn("hits", F.when(apart(pairs(F.col("kept"))), F.col("kept")).when(apart(pairs(F.col("strict"))), F.col("strict")))
        .where(F.size("hits") > 0)
        .withColumn("plain", F.size(F.array_distinct(F.flatten(F.transform("hits", plain_at)))))
        .where((F.col("kind") == 0) | (F.col("plain") >= F.greatest(F.lit(1), F.least(F.lit(PLAIN), "certain"))))
        .withColumn("covered", F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["word"], h["word"] + h["width_words"] - 1)))))
    )
    # literal windows have no values to differ in
    other = (F.col("kind") == 1) & F.exists(pairs(F.col("hits")), lambda x: x["a"] != x["b"])
    return one.groupBy("doc_id", "text_key", "item_id", "item_words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).alias("covered_words"), F.coalesce(F.bool_or(other), F.lit(False)).alias("reparameterised")
    )
