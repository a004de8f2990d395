"""Operator 1: benchmark decontamination by template windows.

Words lose their punctuation and case; numbers (in digits or spelled), capitalised words inside a sentence and units
after a number become typed placeholders. Capitalised words in a row are one name, and spelled numbers in a row one
number, so that "Anna Smith" and "Bert", or "forty two" and "7", fill the same slot. Windows of ``WIDTH`` such words are joined by hash between documents and benchmark items, so a
question with other numbers or names still matches. Places are counted in words after all runs are taken together,
so that names of different lengths don't shift them. Matches of a document and an item on one diagonal are taken
together, and then its diagonals, the longest first; their slots must be consistent: an item's value always stands for
one value of the document and the other way round, and a diagonal that contradicts longer ones doesn't count. A document is contaminated by an item if consistent windows cover ``SHARE`` of the item's, or of
those that aren't mostly placeholders.

A window has up to three keys. In the first, a capitalised word that opens a sentence, or one in capitals, is a plain
word; in the second, every word with a capital letter in front (Latin, Greek, Cyrillic) is a name, so that names
match wherever they stand, but for nouns: articles, and inside a sentence what follows an article or a number. A word that
opens a sentence is no part of the name behind it if the document has that name elsewhere. Particles inside a name belong
to it. Slots are held for consistency with and without the second. The third has all words
as they are, so that a verbatim copy always matches.

Benchmark windows are sent to all executors as sorted hashes while they are at most ``MOST_WINDOWS`` (32 MB), so that
only matching windows are shuffled; with more, all windows are.

Defined cases: null and empty texts match nothing; windows with more placeholders than words match verbatim
only; items of fewer than ``WIDTH`` words are one window, and under ``LEAST`` words none; repeated rows of a doc_id or item count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomill.llm import textscan as ts
from phylomill.llm.repeats import named, without
from phylomill.stash import stash

WIDTH, LEAST = 8, 5
SHARE = 0.5
MOST_WINDOWS = 4_000_000
# Units that count as such after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds "
    "ms s min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "ml l liter liters litre litres gallon gallons kmh mph percent dollars dollar euro euros cents cent degrees celsius fahrenheit "
    "stunde stunden tag tage jahr jahre minuten heure heures jour jours an ans minutos hora horas horas día días año años"
).split()
# Words that are numbers.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend "
    "deux trois quatre cinq huit neuf dix onze douze vingt trente quarante cinquante cent mille "
    "dos tres cuatro cinco siete ocho nueve diez once doce veinte treinta cuarenta cincuenta cien mil"
).split()
# What stands before a capitalised noun rather than a name.
ARTICLES = (
    "der die das den dem des ein eine einen einem einer eines kein keine keinen keinem keiner am im zum zur vom beim ins ans "
    "mein meine meinen meinem dein deine sein seine seinen seinem ihr ihre ihren ihrem unser unsere jeder jede jedes dieser diese dieses diesen the le les une el los las"
).split()
# What stands inside a name, and what may follow it there.
PARTICLES = "de del della di da van von zu".split()
SECOND = "de den der la las los".split()
WORD, NUMBER, NAME, UNIT = range(4)
_PLACE = ts.mix(np.arange(1, 5, dtype=np.uint64))
_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin-1 letters."""
    out = ts.LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E) & (data[lead + 1] != 0x97)]
    out[lead + 1] += 0x20
    return out


def _hashes(data: np.ndarray, words: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word's letters and digits, and how many bytes of them it has."""
    keep = _KEEP[data]
    at = np.concatenate([[0], np.cumsum(keep)])
    body = _lowered(data)[keep]
    c = ts.prefix_hash(body)
    a, b = at[words.start], at[words.end]
    _, inv = ts.powers(len(body) + 1)
    return ts.mix((c[b] - c[a]) * inv[a]), b - a


_lists: dict[str, np.ndarray] = {}


def _keys(name: str, words: list[str]) -> np.ndarray:
    """Sorted hashes of a word list, made once for each process."""
    if name not in _lists:
        data = np.frombuffer(" ".join(sorted(set(words))).encode(), np.uint8)
        _lists[name] = np.sort(_hashes(data, ts.Words(data, np.array([0, len(data)])))[0])
    return _lists[name]


def _joined(kind: np.ndarray, spelled: np.ndarray, first: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where a template word starts, if names in a row and spelled numbers in a row are one."""
    head = np.ones(len(kind), bool)
    again = (kind[1:] == kind[:-1]) & ((kind[1:] == NAME) | spelled[1:] & spelled[:-1])
    head[1:] = ~(again & ~breaks[1:])
    head[np.minimum(first[:-1], max(len(kind) - 1, 0))[np.diff(first) > 0]] = True
    return np.flatnonzero(head)


class Template:
    """Words of the documents in a slice: hash, kind, place in the bytes, and each document's first; and the views of
    them as template words, (kinds, heads of runs, each document's first run)."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        words = ts.Words(data, off)
        h, size = _hashes(data, words)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        number = digits[words.end] > digits[words.start]
        head = data[words.start] if len(words.start) else np.zeros(0, np.uint8)
        second = data[np.minimum(words.start + 1, max(len(data) - 1, 0))] if len(head) else head
        upper = (head >= 65) & (head <= 90) & ~((second >= 65) & (second <= 90)) | (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        greek, cyrillic = (head == 0xCE) & (second >= 0x86) & (second <= 0xAB), (head == 0xD0) & (second >= 0x80) & (second <= 0xAF)
        capital = (head >= 65) & (head <= 90) | (head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97) | greek & (second != 0x90) | cyrillic
        opens = np.ones(len(h), bool)
        if len(h):
            opens[1:] = _STOP[data[words.end[:-1] - 1]]
            opens[1:] |= np.diff(np.concatenate([[0], np.cumsum(data == 10)])[words.start]) > 0
            opens[np.minimum(words.first[:-1], len(h) - 1)] = True
        kind = np.where(number, NUMBER, np.where(upper & ~opens, NAME, WORD)).astype(np.int8)
        real = np.flatnonzero(size > 0)
        self.first = np.searchsorted(real, words.first)
        self.start, self.end, self.kind, h = words.start[real], words.end[real], kind[real], h[real]
        spelled = (self.kind != NUMBER) & ts.among(_keys("numbers", NUMBERS), h)
        self.kind[spelled] = NUMBER
        after = np.zeros(len(real), bool)
        after[1:] = self.kind[:-1] == NUMBER
        self.kind[after & (self.kind == WORD) & ts.among(_keys("units", UNITS), h)] = UNIT
        # inside a sentence, a capitalised word behind an article or a number is a noun
        article = ts.among(_keys("articles", ARTICLES), h)
        noun = np.zeros(len(real), bool)
        noun[1:] = (article[:-1] | (self.kind[:-1] == NUMBER)) & ~opens[real[1:]]
        small = ~capital[real]
        inner, second = (ts.among(_keys(name, words_), h) & small for name, words_ in (("particles", PARTICLES), ("second", SECOND)))
        noun[2:] &= ~(inner[:-2] & second[1:-1])
        self.kind[noun & (self.kind == NAME)] = WORD
        self.plain = h
        self.wide = np.where((self.kind == WORD) & capital[real] & ~noun & ~article, NAME, self.kind).astype(np.int8)
        for k in (self.kind, self.wide):
            name = k == NAME
            one = np.flatnonzero(name[:-2] & inner[1:-1] & name[2:]) + 1
            two = np.flatnonzero(name[:-3] & inner[1:-2] & second[2:-1] & name[3:]) + 1
            k[np.concatenate((one, two, two + 1))] = NAME
        self.data = data
        # a run of names doesn't go on behind a full stop
        breaks = np.concatenate([[True], _STOP[data[words.end[real][:-1] - 1]]]) if len(real) else np.zeros(0, bool)
        every = np.arange(len(real))
        apart = breaks | self._own_names(opens[real])
        heads = [_joined(k, spelled, self.first, b) for k, b in ((self.kind, breaks), (self.wide, apart))] + [every]
        self.views = [(kind, at, np.searchsorted(at, self.first)) for kind, at in zip((self.kind, self.wide, None), heads)]
        # the place of a word counts the runs of the second view; texts that differ in the length of names agree in it
        is_head = np.zeros(len(real), np.int64)
        is_head[heads[1]] = 1
        self.place = np.cumsum(is_head) - 1
        self.count = np.diff(self.views[1][2])

    def _own_names(self, opens: np.ndarray) -> np.ndarray:
        """Names right behind a capitalised word that opens a sentence, which their document also has without this word: the
        opening word is no part of them."""
        out = np.zeros(len(opens), bool)
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)).astype(np.uint64)
        name = np.flatnonzero(self.wide == NAME)
        if not len(name):
            return out
        inside = (name > 0) & (name > self.first[:-1][doc[name].astype(np.int64)])
        before = np.where(inside, self.plain[name - 1], np.uint64(0))
        alone = ts.mix(self.plain[name] + doc[name])
        _, group, every = np.unique(alone, return_inverse=True, return_counts=True)
        _, pair, same = np.unique(ts.mix(alone + before), return_inverse=True, return_counts=True)
        follows = inside & opens[name - 1] & (self.wide[name - 1] == NAME)
        out[name[follows & (every[group] > same[pair])]] = True
        return out

    def windows(self, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Starts (in template words of the view), hashes and documents of the windows that lie in one document, by key."""
        out = []
        for key, (kind, heads, first) in enumerate(self.views):
            at = np.arange(max(len(heads) - width + 1, 0))
            doc = np.searchsorted(first, at, "right") - 1
            ok = at + width <= first[doc + 1]
            plain = self.plain[heads]
            if kind is None:
                g, salt = ts.gram_hash(plain, width)[: len(at)], width + 1000
            else:
                own = kind[heads]
                g, salt = ts.gram_hash(np.where(own == WORD, plain, _PLACE[own]), width)[: len(at)], width
                slots = np.concatenate([[0], np.cumsum(own != WORD)])
                ok &= 2 * (slots[at + width] - slots[at]) <= width
                if key == 1:
                    changed = np.concatenate([[0], np.cumsum(self.wide != self.kind)])
                    end = np.append(heads, len(self.plain))[at + width]
                    ok &= changed[end] > changed[heads[at]]
            out.append((at[ok], ts.mix(g[ok] + np.uint64(salt)), doc[ok]))
        return out

    def slots(self, at: int, width: int, key: int) -> list[str]:
        """Values in the placeholders of a window, in order; each starts with its kind."""
        kind, heads, first = self.views[key]
        last = np.searchsorted(first, at, "right")
        ends = np.append(heads[at + 1 : at + width + 1], self.first[last])[:width].tolist()
        out = []
        for i, j in zip(heads[at : at + width].tolist(), ends):
            if kind[i] != WORD:
                value = self.data[self.start[i] : self.end[j - 1]]
                out.append(f"{kind[i]}{value[_KEEP[value]].tobytes().decode(errors='replace').lower()}")
        return out

    def whole(self, at: int, width: int) -> list[str]:
        """Values of the placeholders, by the first view, of a window of plain words."""
        runs = self.views[0][1]
        i = int(np.searchsorted(runs, at))
        out = []
        for j in range(i, int(np.searchsorted(runs, at + width))):
            a, b = int(runs[j]), int(min(runs[j + 1] if j + 1 < len(runs) else len(self.plain), at + width))
            if self.kind[a] != WORD:
                value = self.data[self.start[a] : self.end[b - 1]]
                out.append(f"{self.kind[a]}{value[_KEEP[value]].tobytes().decode(errors='replace').lower()}")
        return out


def _windows(widths: list[int] | None, keys: np.ndarray | None, width: int, least: int):
    """Rows (id, hash, place, slots, key, size): windows with a hash in ``keys``; without ``widths`` an item's own windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ts.utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in ts.slices(off):
                t = Template(np.ascontiguousarray(data[off[i] : off[j]]), off[i : j + 1] - off[i])
                for w in widths or range(least, width + 1):
                    for key, (at, h, doc) in enumerate(t.windows(w)):
                        if widths is None:
                            # an item shorter than a window is one window in each view
                            own_count = np.diff(t.views[key][2])[doc]
                            ok = (own_count == w) | (own_count > w) & (w == width)
                        else:
                            ok = ts.among(keys, h) if keys is not None else np.ones(len(h), bool)
                        at, h, doc = at[ok], h[ok], doc[ok]
                        if len(at):
                            heads = t.views[key][1]
                            if key < 2:
                                slots = [t.slots(a, w, key) for a in at.tolist()]
                            else:
                                slots = [t.whole(a, w) if widths is None else None for a in at.tolist()]
                            place = t.place[heads[at]]
                            yield pa.record_batch({
                                "id": pa.array([ids[i + d] for d in doc.tolist()], pa.int64()), "hash": h.view(np.int64), "place": place - t.place[t.first[doc]],
                                "slots": pa.array(slots, pa.list_(pa.string())), "key": np.full(len(at), key, np.int32), "size": np.full(len(at), w, np.int32),
                            })

    return run


_SCHEMA = "id long, hash long, place long, slots array<string>, key int, size int"


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, coverage, exact): items that a document has; ``exact``: all slots have the item's values.

    ``items`` has item_id and text.
    """
    bench = named(items.select(F.col("item_id").alias("doc_id"), "text")).dropDuplicates(["doc_id"])
    own = stash(bench.mapInArrow(_windows(None, None, width, least), _SCHEMA), "items")
    # short items have windows of other widths
    widths = sorted({width, *(r.size_ for r in own.select(F.col("size").alias("size_")).distinct().collect())})
    hashes = own.select("hash").distinct()
    keys = None
    if hashes.count() <= MOST_WINDOWS:
        keys = np.sort(np.array([r.hash for r in hashes.toLocalIterator()], np.int64).view(np.uint64))
    places = own.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("place").alias("n"), F.countDistinct(F.when(F.col("key") < 2, F.col("place"))).alias("n_light"))
    found = named(docs).mapInArrow(_windows(widths, keys, width, least), _SCHEMA).select(F.col("id").alias("doc_id"), "hash", F.col("place").alias("at"), F.col("slots").alias("own"), F.col("key").alias("doc_key"))
    heavy = own.groupBy("id", "place").agg((F.min("key") == 2).alias("heavy"))
    # written, so that the join by hash reads two plain exchanges and a window of many items and documents can be split
    sure = own.where("key = 0").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("slots"))).alias("sure"))
    bench = own.join(heavy, ["id", "place"]).join(sure, "id", "left").withColumn("sure", F.coalesce("sure", F.array().cast("array<string>")))
    bench = stash(bench.withColumnRenamed("id", "item_id"), "windows")
    # a verbatim window has the item's own values
    found = found.join(bench, "hash").withColumn("own", F.coalesce("own", "slots")).where(F.size("own") == F.size("slots"))
    found = found.withColumn("pairs", F.arrays_zip(F.col("slots").alias("x"), F.col("own").alias("y")))
    # slots are consistent with the second keys, or without them; then a second key's values still hold for what is a
    # name, a number or a unit of the item by the first as well
    second = (F.col("key") == 1) | (F.col("doc_key") == 1)
    row = lambda wide, counts, pairs: F.struct(F.lit(wide).alias("wide"), counts.alias("counts"), pairs.alias("pairs"))
    held = F.filter("pairs", lambda p: F.array_contains("sure", p["x"]))
    found = found.withColumn("r", F.explode(F.array(row(True, F.lit(True), F.col("pairs")), row(False, ~second, F.when((F.col("key") == 1) & (F.col("doc_key") == 1), held).when(second, F.slice("pairs", 1, 0)).otherwise(F.col("pairs"))))))
    found = found.select("doc_id", "item_id", "r.*", "place", "heavy", (F.col("at") - F.col("place")).alias("diagonal"))
    lines = found.groupBy("doc_id", "item_id", "wide", "diagonal").agg(F.collect_set(F.when(F.col("counts"), F.struct("place", "heavy"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    lines = lines.where(_consistent(F.col("pairs")))
    # the diagonals of a pair, the longest first; one whose slots contradict those before it doesn't count
    each = F.reverse(F.array_sort(F.collect_list(F.struct(F.size("places").alias("n"), "diagonal", "places", "pairs"))))

    def together(s, d):
        pairs = F.array_union(s["pairs"], d["pairs"])
        return F.when(_consistent(pairs), F.struct(F.array_union(s["places"], d["places"]).alias("places"), pairs.alias("pairs"))).otherwise(s)

    whole = lines.groupBy("doc_id", "item_id", "wide").agg(each.alias("each")).withColumn("each", F.aggregate("each", F.struct(F.expr("slice(each[0].places, 1, 0)").alias("places"), F.expr("slice(each[0].pairs, 1, 0)").alias("pairs")), together))
    whole = whole.select("doc_id", "item_id", "wide", "each.places", F.forall("each.pairs", lambda p: p["x"] == p["y"]).alias("exact"))
    of_light = F.when(F.col("n_light") > 0, F.size(F.filter("places", lambda p: ~p["heavy"])) / F.col("n_light"))
    whole = whole.join(places, "item_id").select("doc_id", "item_id", "wide", F.greatest(F.size("places") / F.col("n"), of_light).alias("coverage"), "exact")
    best = F.max_by(F.struct("coverage", "exact"), F.struct("coverage", ~F.col("wide"))).alias("best")
    return whole.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.coverage", "best.exact").where(F.col("coverage") >= share)


def _consistent(pairs: Column) -> Column:
    """Whether no value of either side has two of the other."""
    side = lambda x: F.size(F.array_distinct(F.transform(pairs, lambda p: p[x])))
    return (side("x") == F.size(pairs)) & (side("y") == F.size(pairs))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, their columns unchanged."""
    bad = matches(docs, items).select("doc_id").distinct()
    return without(docs, bad)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    by_doc = matches(docs, items).groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.min("exact").alias("exact"))
    out = docs.select("doc_id").join(by_doc, "doc_id", "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), "exact")
