"""Command line: list the chapters of books, print their text, or turn them into audio and transcripts."""

from __future__ import annotations

import argparse
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import chapters as C
from folioflow.operators import clips, encode, engines, state, timeline
from folioflow.plans import pipeline
from folioflow.sources import config, epub


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folioflow", description=__doc__)
    subs = top.add_subparsers(dest="command")

    def command(name: str, about: str) -> argparse.ArgumentParser:
        sub = subs.add_parser(name, help=about, description=about)
        sub.add_argument("epub", nargs="+")
        sub.add_argument("--toc-depth", type=int, default=C.TOC_DEPTH)
        sub.add_argument("--min-chars", type=int, default=C.MIN_CHARS)
        return sub

    command("chapters", "list the chapters found in each book")
    dump = command("dump-text", "print the text of each chapter")
    dump.add_argument("--chapter", type=int)
    dump.add_argument("--normalized", action="store_true")
    dump.add_argument("--split", action="store_true")
    dump.add_argument("--max-chars", type=int, default=T.MAX_CHARS)
    convert = command("convert", "speak each book and write its audio and transcript")
    convert.add_argument("--engine", required=True)
    convert.add_argument("-o", "--out-dir", required=True)
    convert.add_argument("--config")
    return top


def _tables(spark: SparkSession, args: argparse.Namespace) -> tuple[dict[str, DataFrame], list[str]]:
    books = epub.read_epubs(spark, args.epub).cache()
    failed = [f"{r.path}: {r.error}" for r in books.where("error is not null").select("path", "error").collect()]
    return epub.tables(books), failed


def _chapters(tables: dict[str, DataFrame], args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return C.detected(tables["spine_docs"], tables["paragraphs"], tables["toc"], tables["books"], args.toc_depth, args.min_chars)


def clashing(books: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Slugs of (book_id, slug) that several books would write to."""
    by: dict[str, set[str]] = {}
    for book, name in books:
        by.setdefault(name, set()).add(book)
    return {n: sorted(b) for n, b in by.items() if len(b) > 1}


def list_chapters(spark: SparkSession, args: argparse.Namespace) -> int:
    tables, failed = _tables(spark, args)
    found, _ = _chapters(tables, args)
    rows = C.report(found, tables["spine_docs"], tables["paragraphs"]).orderBy("book_id", "chapter_idx")
    for r in rows.toLocalIterator():
        print(f"{r.chapter_idx:>4}  {r.title:<50}  {r.paras:>5} paras  {r.chars:>8} chars  {r.docs:>3} docs")
    return _end(failed)


def print_text(spark: SparkSession, args: argparse.Namespace) -> int:
    tables, failed = _tables(spark, args)
    found, members = _chapters(tables, args)
    if args.chapter is not None and found.where(F.col("chapter_idx") == args.chapter).isEmpty():
        failed.append(f"no chapter {args.chapter}")
    titles = {(r.book_id, r.chapter_idx): r.title for r in found.select("book_id", "chapter_idx", "title").collect()}
    lines = pipeline.dump_text(members, tables["paragraphs"], args.normalized, args.split, args.chapter, args.max_chars)
    now = None
    for r in lines.orderBy("book_id", "chapter_idx", "doc_pos", "para_pos", "piece_pos").toLocalIterator():
        if (r.book_id, r.chapter_idx) != now:
            now = (r.book_id, r.chapter_idx)
            print(f"== {r.chapter_idx}. {titles[now]}")
        print(r.line)
    return _end(failed)


def speak(spark: SparkSession, args: argparse.Namespace) -> int:
    tables, failed = _tables(spark, args)
    settings = config.load(args.config)
    engine = engines.create(args.engine, settings)
    out = Path(args.out_dir)
    out.mkdir(parents=True, exist_ok=True)
    books = {r.book_id: r for r in tables["books"].withColumn("slug", T.slug(F.coalesce("title", F.lit("")))).collect()}
    clash = clashing([(b, r.slug) for b, r in books.items()])
    failed += [f"{n}: wanted by {len(b)} books" for n, b in clash.items()]
    cache = Path(settings.cache).resolve()  # workers don't share the driver's working directory
    root = str(cache / "state")
    with engines.ready(engine):
        made = pipeline.convert(spark, tables, root, engine)
    fp16 = engines.digest(engine.fingerprint())[:16]
    wavs = cache / "chapters" / fp16
    for r in made["vtt"].toLocalIterator():
        if books[r.book_id].slug not in clash:
            (out / f"{books[r.book_id].slug}.vtt").write_text(r.vtt, encoding="utf-8")
    # chapter files that are there and whose plan hasn't changed stay as they are
    there = [(p.stem[:16], int(p.stem[17:])) for p in wavs.glob("*.wav")]
    short = F.substring("book_id", 1, 16).alias("b16")
    kept = spark.createDataFrame(there, "b16 string, chapter_idx int").join(made["stale"].select(short, "chapter_idx"), ["b16", "chapter_idx"], "left_anti")
    wanted = made["placed"].withColumn("b16", short).join(kept, ["b16", "chapter_idx"], "left_anti")
    encode.chapter_wavs(wanted, state.clips(spark, root, fp16), str(wavs), engine.sample_rate)
    paths = made["timeline"].select("book_id", "chapter_idx", F.format_string(f"{wavs}/%s-%04d.wav", F.substring("book_id", 1, 16), "chapter_idx").alias("path"))
    if shutil.which("ffmpeg") is None:
        print(f"ffmpeg is not installed; {paths.count()} chapter files are in {wavs}", file=sys.stderr)
        return _end(failed)
    lists = timeline.concat_list(paths).join(paths.groupBy("book_id").agg(F.collect_list("path").alias("paths")), "book_id")
    lists = lists.join(made["timeline"].groupBy("book_id").agg(F.sum("samples").alias("samples")), "book_id")
    ready = [r for r in made["metadata"].join(lists, "book_id").toLocalIterator() if books[r.book_id].slug not in clash]
    digests = {r.book_id: encode.settings_digest(metadata=r.metadata, engine=fp16) for r in ready}
    stamped = {r.book_id: r.digest for r in state.stamps(spark, root).collect()}
    for r in ready:
        book = books[r.book_id]
        target = out / f"{book.slug}.m4b"
        if stamped.get(r.book_id) == digests[r.book_id] and encode.is_current(target, [Path(p) for p in r.paths], len(r.paths)):
            print(f"{target} is up to date")
            continue
        one = lambda digest, book_id=r.book_id: spark.createDataFrame([(book_id, digest)], "book_id string, digest string")
        state.stamp(one(""), root)  # an encode that breaks off leaves no stamp
        tell = clips.Progress(r.samples / engine.sample_rate, lambda percent, slug=book.slug: print(f"{slug}: {percent} %", file=sys.stderr))
        with tempfile.TemporaryDirectory(dir=cache) as work:
            try:
                encode.write_m4b(r.listing, r.metadata, bytes(book.cover) if book.cover else None, book.cover_mime, target, engine.sample_rate, Path(work), tell)
            except encode.EncodeError as e:  # the other books still get theirs
                failed.append(f"{book.slug}: {e}")
                continue
        state.stamp(one(digests[r.book_id]), root)
    return _end(failed)


def _end(failed: list[str]) -> int:
    for line in failed:
        print(line, file=sys.stderr)
    return int(bool(failed))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return 1
    spark = SparkSession.builder.appName("folioflow").getOrCreate()
    return {"chapters": list_chapters, "dump-text": print_text, "convert": speak}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
