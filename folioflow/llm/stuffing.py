"""Problem 8: keyword-stuffed and link-list pages.

Method: rank-frequency curves. A curve is fitted to the words of every page that don't mark prose, with SQL windows: its slope,
its residual and its height, the mean uses of a word. Each is compared with the pages of the same language and comparable length, by their median
and the spread of their middle half. What marks prose is learned per language from its distinct pages: the words that stand
in many of them and how often, without pages of few words said over and over and without the source that uses a word most.
A page is flagged when most of it diverges from that prose and its curve is steeper, less of a line or higher than that of
its like, or the diverging part is made of links or tags. An index has a flat curve, other matter of a book reads like prose.

Null and empty texts are no case; repeated rows count once; texts are read whole, of any length."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.session import cut, known_rows

COMMON_SHARE = 0.15  # share of a language's pages a word must stand in to mark prose
RATE_SLACK = 3.0  # times its usual rate up to which a word of a line counts as prose
PROSE = 0.1  # share of such words below which a line diverges
PROSE_DENSE = 0.25  # the same in scripts without blanks, whose words here are single characters, most of them common
LEAST_PAGES = 20  # pages of a language from which one source can be left out, and from which it judges pages of other labels
FEW = (20, 400, 0.6)  # from so many words on, a page with fewer different ones than a power of their number (counted up to a most) teaches no prose
SHORT_LINE = 8
LARGER_PART = 0.5
EXTREME = 0.5  # by how many spreads a curve must be steeper, less straight or higher than those of its like
REPEATED = 2.0  # mean uses of a word from which a curve is high whatever its like are
LEAST_SPREAD = 0.02  # no spread counts as less, so that pages much alike don't make small differences extreme
LINKED = 0.3

#: Characters of scripts without blanks, each a word of its own.
_DENSE = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORD = re.compile(rf"[^\W_{_DENSE}]+|[{_DENSE}]")
HOSTS = (".com", ".net", ".org", ".info", ".biz", ".io", ".example", ".test", ".invalid", ".de", ".fr", ".ru", ".es", ".uk")
LINK = re.compile(rf"<a\s[^<>]*>|</a>|(?:https?://|www\.)\S+|(?<![\w@.-])[\w-]+(?:\.[\w-]+)*(?:{'|'.join(map(re.escape, HOSTS))})(?:/\S*)?(?![\w.])")
SPACED = re.compile(r"(?<!\S)\w \w \w (?:\w )*\w(?!\S)")
TAG = re.compile(r"#\w+")
_LETTER = re.compile(r"[^\W\d_]")
_DENSE_CHAR = re.compile(f"[{_DENSE}]")


def linked_line(line: str) -> bool:
    """Whether a line holds a link; most lines are told without the full pattern."""
    if "." not in line and "<a " not in line:
        return False
    return ("://" in line or "www." in line or "<a " in line or any(h in line for h in HOSTS)) and LINK.search(line) is not None


def words(text: str) -> list[str]:
    """Words and figures of ``text``; figures are told apart only where it matters."""
    return WORD.findall(text.casefold())


def repetitive(own: list[str]) -> bool:
    """Whether a page is made of few words said over and over. Single characters of dense scripts are few in any text."""
    least, most, power = FEW
    if len(own) < least or sum(w >= "\u0e00" and len(w) == 1 for w in own) * 2 > len(own):
        return False
    return len(set(own)) < min(len(own), most) ** power


def _usage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, word, pages, uses) summed per batch; the empty word counts pages and words."""
    for batch in batches:
        pages: dict[tuple, Counter] = defaultdict(Counter)
        uses: dict[tuple, Counter] = defaultdict(Counter)
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = words(LINK.sub(" ", text) if linked_line(text) else text)
            if repetitive(own):
                continue
            uses[lang, source].update(own)
            pages[lang, source].update(set(own))
            pages[lang, source][""] += 1
            uses[lang, source][""] += len(own)
        for (lang, source), counts in pages.items():
            keys = list(counts)
            of = uses[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.int64()), pa.array(keys, pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([of[k] for k in keys], pa.int64())],
                names=["lang", "source", "word", "pages", "uses"],
            )


def prose_rates(pages: DataFrame) -> DataFrame:
    """(lang, word, rate, all_pages): words that stand in at least ``COMMON_SHARE`` of the distinct pages of a language.

    Where a language has ``LEAST_PAGES`` and several sources, share and rate of a word are those without the source that has
    most pages with it, so that no source of stuffed pages, however large, makes its keywords prose. The words are bounded by
    a page's mean number of different words over ``COMMON_SHARE``, whatever the number of pages.
    In a language of a few pages almost every word counts as prose, so that none of them is flagged without ground."""
    source = F.xxhash64("source") if "source" in pages.columns else F.lit(0).cast("long")
    texts = pages.where(F.col("text").isNotNull()).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", source.alias("source"))
    texts = texts.groupBy("lang", "text").agg(F.min("source").alias("source")).select("lang", "source", "text")
    counted = texts.mapInArrow(_usage, "lang string, source long, word string, pages long, uses long")
    counted = cut(counted.groupBy("lang", "source", "word").agg(F.sum("pages").alias("pages"), F.sum("uses").alias("uses")))  # read thrice below
    own = counted.where((F.col("word") == "") | ~F.col("word").rlike(r"^\d+$"))
    sizes = own.where("word = ''").select("lang", "source", F.col("pages").alias("source_pages"), F.col("uses").alias("source_uses"))
    whole = sizes.groupBy("lang").agg(F.sum("source_pages").alias("all_pages"), F.sum("source_uses").alias("all_uses"), F.count("*").alias("sources"))
    top = F.max_by(F.struct("source", "pages", "uses"), F.struct("pages", "source")).alias("top")
    told = own.where("word <> ''").groupBy("lang", "word").agg(F.sum("pages").alias("pages"), F.sum("uses").alias("uses"), top)
    told = told.join(F.broadcast(whole), "lang").where(F.col("pages") >= COMMON_SHARE * F.col("all_pages") * 0.5)
    told = told.join(F.broadcast(sizes.withColumnRenamed("source", "top_source")), (told.lang == sizes.lang) & (F.col("top.source") == F.col("top_source"))).select(told["*"], "source_pages", "source_uses")
    without = (F.col("all_pages") >= LEAST_PAGES) & (F.col("sources") > 1)
    less = lambda c, part: F.col(c) - F.when(without, F.col(part)).otherwise(0)
    rated = told.select("lang", "word", "all_pages", (less("pages", "top.pages") / less("all_pages", "source_pages")).alias("share"), (less("uses", "top.uses") / less("all_uses", "source_uses")).alias("rate"))
    return rated.where(F.col("share") >= COMMON_SHARE).select("lang", "word", "rate", "all_pages")


Rates = dict[str, float] | list[dict[str, float]]  # of one language, or of the page's own and then of the others


def by_language(rows: list) -> dict[str, Rates]:
    """Rates to judge a page of each label by; '' stands for any other. Labels may be wrong and a page may hold several
    languages: a line is prose if its own language or any with ``LEAST_PAGES`` says so, each for itself."""
    rates: dict[str, dict[str, float]] = defaultdict(dict)
    size = {}
    for lang, word, rate, n in rows:
        rates[lang][word] = rate
        size[lang] = n
    known = sorted((k for k in rates if size[k] >= LEAST_PAGES), key=lambda k: (-size[k], k))
    return {k: ([rates[k]] if k else []) + [rates[x] for x in known if x != k] for k in ["", *rates]}


def diverges(own: list[str], rates: Rates, dense: bool = False) -> bool:
    """Whether too small a share of a line's words marks prose in any one language. None counts beyond its usual rate, so that
    one such word said again and again doesn't make prose; the sum ends as soon as it suffices."""
    n = len(own)
    least = n * (PROSE_DENSE if dense and sum(w >= "\u0e00" and len(w) == 1 for w in own) * 2 > n else PROSE)
    counts = Counter(own)
    for of in [rates] if isinstance(rates, dict) else rates:
        need = least
        for w, k in counts.items():
            rate = of.get(w)
            if rate is not None:
                need -= min(k, RATE_SLACK * rate * n)
                if need <= 0:
                    return False
    return True


def marks(rates: Rates) -> frozenset[str]:
    """The words that mark prose in any of the languages of ``rates``."""
    return frozenset().union(*([rates] if isinstance(rates, dict) else rates))


def diverging(text: str, rates: Rates, prose: frozenset[str] | None = None) -> tuple[float, float, Counter]:
    """Share of the characters in diverging lines, share of those in lines of links or tags, and how often
    the page uses each word that doesn't mark prose.

    Short lines say too little alone: those of a page are judged together. Lines of figures only, such as times, don't count."""
    whole = apart = linked = 0
    found: Counter = Counter()
    short: list[str] = []
    short_size = short_linked = 0
    dense = _DENSE_CHAR.search(text) is not None
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        has_link = linked_line(line)
        rest = LINK.sub(" ", line) if has_link else line
        if not has_link and not _LETTER.search(line):
            continue
        if " " in rest:
            rest = SPACED.sub(lambda m: "ʘ" + m[0].replace(" ", " ʘ"), rest)  # letters set apart are no words, not even a or I
        size = len(line)
        whole += size
        own = words(rest)
        found.update(own)
        if len(own) >= 2 * SHORT_LINE and not diverges(own, rates, dense):
            continue
        own = [w for w in own if not w.isdigit()]
        marked = has_link or "#" in line and len(TAG.findall(line)) * 2 > len(line.split())
        if len(own) < SHORT_LINE:
            short += own
            short_size += size
            short_linked += size * marked
        elif diverges(own, rates, dense):
            apart += size
            linked += size * marked
    if short_size and (not short or diverges(short, rates, dense)):
        apart += short_size
        linked += short_linked
    prose = marks(rates) if prose is None else prose
    return apart / whole if whole else 0.0, linked / apart if apart else 0.0, Counter({w: n for w, n in found.items() if w not in prose and not w.isdigit()})


MEASURES = ("slope", "residual", "height")


def curves(pages: DataFrame) -> DataFrame:
    """(doc_id, lang, band, words, apart, linked, slope, residual, height) of every page (doc_id, lang, text).

    A page comes out of Python as its histogram, how many words it uses how often, so that each point of its curve is a row,
    not each word. Words used equally often share their mean rank. The line is fitted through log frequency over log rank, each
    point with the number of its words as weight. ``band`` is the length in words as a power of two."""
    spark = pages.sparkSession
    own = pages.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    shared = spark.sparkContext.broadcast(by_language(prose_rates(own).collect()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates = shared.value
        prose = {lang: marks(of) for lang, of in rates.items()}
        kind = pa.list_(pa.struct([("n", pa.int32()), ("k", pa.int32())]))
        for batch in batches:
            out = defaultdict(list)
            for doc, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                apart, linked, found = diverging(text, rates.get(lang or "und", rates[""]), prose.get(lang or "und", prose[""]))
                out["doc_id"].append(doc)
                out["lang"].append(lang or "und")
                out["apart"].append(apart)
                out["linked"].append(linked)
                out["points"].append([{"n": n, "k": k} for n, k in Counter(found.values()).items()])
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["lang"], pa.string()), pa.array(out["apart"], pa.float64()), pa.array(out["linked"], pa.float64()), pa.array(out["points"], kind)], names=["doc_id", "lang", "apart", "linked", "points"])

    parts = own.select("doc_id", "lang", "text").mapInArrow(find, "doc_id long, lang string, apart double, linked double, points array<struct<n:int,k:int>>")
    page = ("doc_id", "lang", "apart", "linked")
    # one row a page, by the key that the window and the sums need as well: one shuffle serves all
    once = parts.groupBy("doc_id").agg(F.max(F.struct("apart", "linked", "lang", "points")).alias("x")).select("doc_id", "x.*")
    each = once.select(*page, F.explode_outer("points").alias("p")).select(*page, F.coalesce("p.n", F.lit(1)).alias("n"), F.coalesce("p.k", F.lit(0)).alias("k"))
    upto = F.sum("k").over(W.partitionBy("doc_id").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0))
    points = each.select(*page, "n", "k", F.log(F.greatest(upto - (F.col("k") - 1) / 2, F.lit(1.0))).alias("x"), F.log(F.col("n").cast("double")).alias("y"))
    weighted = lambda c, name: F.sum(F.col("k") * c).alias(name)
    x, y = F.col("x"), F.col("y")
    sums = points.groupBy("doc_id").agg(
        *[F.max(c).alias(c) for c in page[1:]], F.sum("k").alias("w"), F.sum(F.col("n") * F.col("k")).alias("words"),
        weighted(x, "wx"), weighted(y, "wy"), weighted(x * x, "wxx"), weighted(x * y, "wxy"), weighted(y * y, "wyy"),
    )
    w = F.greatest("w", F.lit(1))
    sxx, sxy, syy = (F.greatest(F.col(p) / w - F.col(a) * F.col(b) / w / w, F.lit(0.0) if p != "wxy" else F.lit(-1e9)) for p, a, b in (("wxx", "wx", "wx"), ("wxy", "wx", "wy"), ("wyy", "wy", "wy")))
    slope = F.when(sxx > 1e-9, sxy / sxx).otherwise(0.0)  # a single point has no slope, only a height
    fitted = sums.withColumns({"slope": slope, "residual": F.sqrt(F.greatest(syy - slope * sxy, F.lit(0.0))), "height": F.log(F.greatest(F.col("words") / w, F.lit(1.0)))})
    return fitted.select(*page[:2], F.floor(F.log2(F.greatest("words", F.lit(1)))).cast("int").alias("band"), "words", *page[2:], *MEASURES)


def _usual(fitted: DataFrame, *keys: str) -> DataFrame:
    """Median and spread of each measure by ``keys``, from sketches that are merged before and after the shuffle."""
    quartiles = [F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in MEASURES]
    known = fitted.groupBy(*keys).agg(F.count("*").alias("pages"), *quartiles)
    each = [F.struct(F.col(c)[1].alias("median"), F.greatest((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(LEAST_SPREAD)).alias("spread")).alias(c) for c in MEASURES]
    return known.select(*keys, "pages", F.struct(*each).alias("like"))


def compared(fitted: DataFrame) -> DataFrame:
    """``curves`` with ``steeper``, ``rougher`` and ``higher``: by how many spreads a page differs from the pages of its language
    and length band, where there are ``LEAST_PAGES`` of them; else from those of its band in all languages, else from all pages."""
    by_lang = _usual(fitted, "lang", "band").where(F.col("pages") >= LEAST_PAGES).select("lang", "band", F.col("like").alias("own"))
    by_band = _usual(fitted, "band").where(F.col("pages") >= LEAST_PAGES).select("band", F.col("like").alias("of_band"))
    every = _usual(fitted).select(F.col("like").alias("of_all"))
    joined = known_rows(known_rows(fitted, by_lang, "lang", "band", how="left"), by_band, "band", how="left").join(F.broadcast(every))
    like = F.coalesce("own", "of_band", "of_all")
    apart = lambda c: (F.col(c) - like[c]["median"]) / like[c]["spread"]
    return joined.select(*fitted.columns, (-apart("slope")).alias("steeper"), apart("residual").alias("rougher"), apart("height").alias("higher"))


def stuffed(pages: DataFrame) -> DataFrame:
    """``compared`` curves of the pages that consist of repeated keywords, bare links or tags in their larger part."""
    extreme = (F.greatest("steeper", "rougher", "higher") >= EXTREME) | (F.col("height") >= math.log(REPEATED) - 1e-9)
    return compared(cut(curves(pages))).where((F.col("apart") >= LARGER_PART) & (extreme | (F.col("linked") >= LINKED)))
