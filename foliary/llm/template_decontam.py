"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of punctuation at their ends; numbers, units after numbers and capitalised words
within sentences become typed placeholders. Windows of WINDOW template words are hashed; those of documents are joined
with those of benchmark items. The windows of an item that match at one alignment count if the values in their slots
can be mapped: one value of the item must stand for one value of the document throughout. So an item is found when its
numbers and names have been exchanged, also names that open sentences, as capitalised words there have both forms, but
not where a template fits by chance; of other alignments the windows with equal values count. A window with few literal
words must have equal values, which are part of its hash, so that it meets none but its equals. On demand windows are also
hashed without slots, so a copy is found whatever its case.

Texts are looked at many together, as one array of words. The benchmark's hashes reach the tasks as a bit array of fixed
size, which lets through the windows that may be the benchmark's, and some in vain when it is very large; these are joined
with the benchmark by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import HEAVY, Workspace, text_groups

#: Words of a window; a shorter item is one window, if it has at least SHORTEST words.
WINDOW, SHORTEST = 13, 5
#: Literal words a window needs, as a share, for its slots to be free.
LITERAL = 0.5
#: Words that open sentences up to which a window has every mixture of forms; with more, all literal and all names.
OPENERS = 6
#: Marks the form of a window without slots.
PLAIN = -2
#: Bits of the filter of the benchmark's hashes, at most: 16 MB, whatever the benchmark's size.
FILTER_BITS = 27
#: Parts that the windows of a very frequent hash are dealt into.
SALTS = 64
#: Words a worker remembers, and characters of all these; characters looked at together.
REMEMBERED, REMEMBERED_CHARACTERS, GROUP = 800_000, 1 << 26, 1 << 19

NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(?:e[+-]?[0-9]+)?%?")
NUMBER_WITH_UNIT = re.compile(r"([+-]?[$€£]?[0-9][0-9.,]*)([a-zµ°%]{1,4})")


def number_words() -> frozenset[str]:
    """Number words of the tables' languages, without those for one, which are articles too.

    Tens and ones have a hyphen in English and French; German joins them, as Spanish does up to 29.
    """
    ones = "one two three four five six seven eight nine".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    english = "zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion".split()
    found = {*ones[1:], *tens, *english, *(f"{t}-{o}" for t in tens for o in ones)}
    ones = "ein zwei drei vier fünf sechs sieben acht neun".split()
    tens = "zwanzig dreißig dreissig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
    found |= {*ones[1:], *tens, *(f"{o}und{t}" for t in tens for o in ones)}
    found |= set("null zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn hundert einhundert tausend eintausend million millionen milliarde milliarden".split())
    found |= {f"{o}{x}" for o in ones[1:] for x in ("hundert", "tausend")}
    ones = "deux trois quatre cinq six sept huit neuf".split()
    teens = "dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
    tens = "vingt trente quarante cinquante soixante septante huitante octante nonante".split()
    found |= {*ones, *teens, *tens, *(f"{t}-{o}" for t in tens for o in ones), *(f"{t}-et-un" for t in tens), *(f"{t}-et-une" for t in tens)}
    found |= {*(f"soixante-{t}" for t in teens), "soixante-et-onze", "quatre-vingt", "quatre-vingts", "quatre-vingt-un", "quatre-vingt-une"}
    found |= {f"quatre-vingt-{x}" for x in ones + teens}
    found |= set("zéro cent cents mille million millions milliard milliards".split())
    ones = "dos tres cuatro cinco seis siete ocho nueve".split()
    found |= {*ones, *set("cero diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte".split())}
    found |= set("veintiún veintiuno veintiuna veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve".split())
    found |= set("treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones".split())
    return frozenset(found | {f"{x}ientos" for x in ("dosc", "tresc", "cuatroc", "seisc", "ochoc")} | {"quinientos", "setecientos", "novecientos"})


NUMBER_WORDS = number_words()
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet mile miles meter meters metre metres mg g kg lb lbs oz gram grams kilogram "
    "kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec ms second seconds min minute minutes h hr hour "
    "hours day days week weeks month months year years mph kph hz khz mhz ghz w kw v a j kj n pa k c f degree degrees % percent "
    "dollar dollars euro euros cent cents usd eur gbp".split()
)
EDGES = "\"'`.,;:!?()[]{}<>«»“”‘’*|…"
NUMBER_HEADS = frozenset("0123456789+-$€£")
CLOSING, SENTENCE_ENDS = "\"')]}»”’", frozenset(".!?:|")
ENDS = SENTENCE_ENDS | frozenset(CLOSING)
NUM, UNIT, NAME = 1, 2, 3
IS_NUMBER, IS_UNIT, IS_CAPITAL, ENDS_SENTENCE, IS_EMPTY = 1, 2, 4, 8, 16
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Numbers for raw words, given as they are met: places of their form, hash and traits."""

    def __init__(self):
        self.form: list[str] = []
        self.traits, self.hashes = np.zeros(1024, np.uint8), np.zeros(1024, np.uint64)
        self.characters = 0

    def __missing__(self, raw: str) -> int:
        bare = raw.strip(EDGES)
        form = bare.lower()
        trait = 0 if form else IS_EMPTY
        if form[:1] in NUMBER_HEADS and (NUMBER.fullmatch(form) or NUMBER_WITH_UNIT.fullmatch(form)) or form in NUMBER_WORDS:
            trait |= IS_NUMBER
        if form in UNITS:
            trait |= IS_UNIT
        if bare[:1].isupper() and bare[1:].islower():
            trait |= IS_CAPITAL
        if raw[-1:] in ENDS and raw.rstrip(CLOSING)[-1:] in SENTENCE_ENDS:
            trait |= ENDS_SENTENCE
        self[raw] = at = len(self.form)
        self.form.append(form)
        if at == len(self.traits):
            self.traits, self.hashes = np.concatenate([self.traits, self.traits]), np.concatenate([self.hashes, self.hashes])
        self.traits[at], self.hashes[at] = trait, xxhash.xxh64_intdigest(form.encode())
        self.characters += len(raw) + len(form)
        return at

    def forget(self) -> None:
        """Begins anew when too much is remembered; numbers given before no longer hold."""
        if len(self) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self.clear()
            self.__init__()


class Template:
    """The words of a text, or of some texts one after the other, as literals and slots."""

    def __init__(self, words: Words, text: str | None | list[str | None]):
        words.forget()
        raw = [(t or "").split() for t in (text if isinstance(text, list) else [text])]
        count = np.fromiter(map(len, raw), np.int64, len(raw))
        at = np.fromiter(map(words.__getitem__, chain.from_iterable(raw)), np.int64, int(count.sum()))
        del raw
        doc = np.repeat(np.arange(len(count)), count)
        trait = words.traits[at]
        opens = np.zeros(len(at), bool)
        opens[1:] = (trait[:-1] & ENDS_SENTENCE > 0) | (doc[1:] != doc[:-1])
        opens[:1] = True
        keep = trait & IS_EMPTY == 0
        if not keep.all():
            at, trait, opens, doc = at[keep], trait[keep], opens[keep], doc[keep]
        self.at, self.words, self.doc = at, words, doc
        self.begin = np.searchsorted(doc, np.arange(len(count)))
        self.literal = words.hashes[at]
        self.kind = np.where(trait & IS_NUMBER > 0, NUM, 0)
        after_number = np.zeros(len(at), bool)
        after_number[1:] = (self.kind[:-1] == NUM) & (doc[1:] == doc[:-1])
        # A unit after a number is one even if it is a number word, as cent is.
        self.kind = np.where((trait & IS_UNIT > 0) & after_number, UNIT, self.kind)
        capital = (self.kind == 0) & (trait & IS_CAPITAL > 0)
        self.kind = np.where(capital & ~opens, NAME, self.kind)
        self.openers = np.flatnonzero(capital & opens)
        self.opens_capital = bool(len(self.openers)) and self.openers[0] == 0

    def __len__(self) -> int:
        return len(self.at)

    def forms(self, size: int, any_case: bool) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(starts, hashes, named): the windows as they are, then those in which openers of sentences are names too.

        Bit j of named stands for the window's opener j; -1 for all of them. With any_case, last come, as PLAIN, windows
        with slots as words alone, so that a copy is met whatever its case. Of a window that isn't free the values in the
        slots are part of the hash.
        """
        n = len(self.at) - size + 1
        if n <= 0:
            return []
        inside = self.doc[:n] == self.doc[size - 1 :]
        every = np.flatnonzero(inside)
        slot = self.kind > 0
        slots = windowed(slot.astype(np.int64), size)
        plain = mix(self.literal)
        some = bool(slot.any())
        tag = mix(self.kind.astype(np.uint64)) if some else plain
        forward, back = powers(len(plain) + 1)
        forward = forward[:-1]
        by_kind = np.where(slot, tag, plain) if some else plain
        by_value = np.where(slot, mix(self.literal ^ tag), plain) if some else plain
        sums = windowed(by_kind * forward, size)
        valued = windowed(by_value * forward, size) if some else sums
        name = mix(np.array([NAME], np.uint64))
        first = np.searchsorted(self.openers, np.arange(n))
        count = np.searchsorted(self.openers, np.arange(n) + size) - first
        change = (name - plain[self.openers]) * forward[self.openers]
        change_valued = (mix(self.literal[self.openers] ^ name) - plain[self.openers]) * forward[self.openers]

        def hashed(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
            return mix(sums * back[at] + np.uint64(size)).view(np.int64)

        def form(at: np.ndarray, names: np.ndarray | int, moved, named: int) -> tuple[np.ndarray, np.ndarray, int]:
            """moved: what the names change in the sums, for changes of either kind."""
            free = size - slots[at] - names >= LITERAL * size
            total = sums[at] + moved(change)
            if not free.all():
                total = np.where(free, total, valued[at] + moved(change_valued))
            return at, hashed(total, at), named

        out = [form(every, 0, lambda change: np.uint64(0), 0)]
        if len(self.openers):
            few = every[(count[every] > 0) & (count[every] <= OPENERS)]
            for named in range(1, 1 << min(OPENERS, int(count.max()))):
                if named & named - 1 == 0:
                    few = few[count[few] >= named.bit_length()]
                if not len(few):
                    break
                bits = [j for j in range(named.bit_length()) if named >> j & 1]
                out.append(form(few, len(bits), lambda change, few=few, bits=bits: sum(change[first[few] + j] for j in bits), named))
            many = every[count[every] > OPENERS]
            if len(many):

                def moved(change):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(change, dtype=np.uint64)])
                    return total[first[many] + count[many]] - total[first[many]]

                out.append(form(many, count[many], moved, -1))
        if any_case and some:
            at = every[slots[every] > 0]
            out.append((at, hashed(windowed(plain * forward, size)[at], at), PLAIN))
        return out

    def names(self, start: int, size: int, named: int) -> list[int]:
        """Places of the openers that are names in a form of the window."""
        if named in (0, PLAIN):
            return []
        s, e = np.searchsorted(self.openers, [start, start + size])
        return [int(x) for j, x in enumerate(self.openers[s:e]) if named < 0 or named >> j & 1]

    def slots(self, start: int, size: int, first_is_name: bool = False, names: list[int] = (), plain: bool = False) -> list[str]:
        part = range(start, start + size) if not plain else ()
        return [self.words.form[self.at[i]] for i in part if self.kind[i] or i in names or (first_is_name and i == 0)]


def windowed(values: np.ndarray, size: int) -> np.ndarray:
    """The sum of each `size` values that follow each other."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[size:] - total[:-size]


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers = tuple(
            np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, b, np.uint64))]) for b in (BASE, INVERSE)
        )
    return _powers[0][:n], _powers[1][:n]


BENCH = "hash long, size int, item_id long, place int, n_windows int, item_slots array<string>, item_named boolean"
DOC = "hash long, doc long, at int, slots array<string>, named boolean"


def benchmark_windows(items: DataFrame, any_case: bool, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row for each form of each window of each item; capitalised words that open sentences are literals and names.

    A form with a name other than the first word of the item is marked, as it may fit by less than the window's words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                t = Template(words, text.as_py())
                size = min(WINDOW, len(t))
                if size < SHORTEST:
                    continue
                for at, hashes, named in t.forms(size, any_case):
                    for i, h in zip(at.tolist(), hashes.tolist(), strict=True):
                        names = t.names(i, size, named)
                        marked = bool(names) and names != [0]
                        rows.append((h, size, item.as_py(), i, len(t) - size + 1, t.slots(i, size, names=names, plain=named == PLAIN), marked))
                if len(rows) > 20000:
                    yield from record(rows, BENCH)
                    rows = []
            yield from record(rows, BENCH)

    return items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, BENCH)


def record(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [x.split(" ") for x in schema.split(", ")]
    if rows:
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """Bits at the places that the leading and the last bits of each of the hashes (column hash) give, as uint64.

    There are 1024 bits for a hash, within FILTER_BITS. Of other hashes some (2 / 1024)^2 pass; (2 n / 2^FILTER_BITS)^2
    of them where n hashes don't have as much room, 0.1 % at two million.
    """
    n = hashes.count()
    bits = min(FILTER_BITS, max(6, (1024 * n).bit_length()))
    places = F.array(F.call_function("shiftrightunsigned", F.col("hash"), F.lit(64 - bits)), F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)))
    each = hashes.select(F.explode(places).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    # As many rows as the filter has words.
    found = each.select(F.shiftright("place", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def in_filter(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that pass."""
    bits = len(filter_).bit_length() + 5
    hashes = hashes.view(np.uint64)
    some = np.arange(len(hashes))
    for place in (hashes >> np.uint64(64 - bits), hashes & np.uint64((1 << bits) - 1)):
        place = place[some]
        some = some[filter_[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1]
    return some


def document_windows(docs: DataFrame, sizes: list[int], filter_: np.ndarray, any_case: bool, id_col: str, text_col: str) -> DataFrame:
    """A row for each form of each window of each text that the filter lets through."""
    image = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, wanted = Words(), image.value
        for batch in batches:
            done = 0
            for texts in text_groups(batch.column(1), GROUP):
                ids = batch.column(0).slice(done, len(texts)).to_pylist()
                done += len(texts)
                t = Template(words, texts)
                rows = []
                for size in sizes:
                    for at, h, named in t.forms(size, any_case):
                        met = in_filter(wanted, h)
                        for i, x in zip(at[met].tolist(), h[met].tolist(), strict=True):
                            k = t.doc[i]
                            slots = t.slots(i, size, names=t.names(i, size, named), plain=named == PLAIN)
                            rows.append((x, ids[k], i - int(t.begin[k]), slots, named not in (0, PLAIN)))
                            if len(rows) > 20000:
                                yield from record(rows, DOC)
                                rows = []
                yield from record(rows, DOC)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, DOC)


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    any_case: bool = False, item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_windows, n_exact, n_changed, share) for each document and item that share a window.

    n_windows counts places of the item that are found, n_exact those with equal slots somewhere, n_changed the others,
    share is n_windows by the item's windows. With any_case windows also count whose lower-cased words are equal, whatever
    the template makes of them. Null and empty texts hold nothing, rows with a null id are left out; equal rows and rows of
    one id count together. Items of fewer than SHORTEST words are left out: a few words occur by chance. Very long texts
    are read whole; other columns are not read. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "templates")
    bench = work.write(benchmark_windows(items.where(F.col(item_id_col).isNotNull()), any_case, item_id_col, item_text_col).distinct(), "bench")
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())
    wanted = hash_filter(bench.select("hash").distinct())
    found = work.write(document_windows(docs.where(F.col(id_col).isNotNull()), sizes, wanted, any_case, id_col, text_col), "found")
    # Of a hash that very many windows have, which are fewer than HEAVY hashes, windows are dealt into parts.
    counts = work.write(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "counts")
    often = F.broadcast(counts.where(F.col("n") > (counts.agg(F.sum("n")).first()[0] or 0) / HEAVY).select("hash", F.lit(SALTS).alias("parts")))
    salted = found.join(often, "hash", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(F.lit("salt"), "doc"), "parts"), F.lit(0)).cast("int"))
    dealt = bench.join(often, "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    pairs = salted.drop("parts").join(dealt.drop("parts", "size"), ["hash", "salt"])
    equal = F.col("item_slots") == F.col("slots")
    windows = pairs.select(
        "doc", "item_id", "place", (F.col("at") - F.col("place")).alias("shift"), "n_windows",
        F.struct(F.arrays_zip("item_slots", "slots").alias("slots"), equal.alias("equal"), "place", (F.col("item_named") | F.col("named")).alias("named")).alias("w"),
    )
    # The windows of one alignment, as many as the item has at most, are looked at together.
    aligned = windows.groupBy("doc", "item_id", "shift", "n_windows").agg(F.collect_set("w").alias("ws"))
    # Names that open sentences must fit with all windows; the others are not judged by them.
    def fitting(ws):
        slots = F.array_distinct(F.flatten(F.transform(ws, lambda w: w["slots"])))
        return F.size(F.array_distinct(F.transform(slots, lambda x: x["item_slots"]))) == F.size(slots)

    plain = fitting(F.filter("ws", lambda w: ~w["named"]))
    # In a step of its own: beside explode it would be judged anew for each window.
    judged = aligned.select("doc", "item_id", "n_windows", "ws", plain.alias("plain"), fitting(F.col("ws")).alias("fits"))
    places = (
        judged.select("doc", "item_id", "n_windows", "plain", "fits", F.explode("ws").alias("w"))
        .where("fits or w.equal or plain and not w.named")
        .groupBy("doc", "item_id", F.col("w.place").alias("place"))
        .agg(F.max("w.equal").alias("exact"), F.max("n_windows").alias("all"))
    )
    return places.groupBy(F.col("doc").alias("doc_id"), "item_id").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if("exact").alias("n_exact"),
        F.count_if(~F.col("exact")).alias("n_changed"),
        (F.count(F.lit(1)) / F.max("all")).alias("share"),
    )
