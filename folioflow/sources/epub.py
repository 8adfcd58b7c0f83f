"""EPUB files as tables: the container is read with the standard library, one file a row of Spark's binary source."""

from __future__ import annotations

import hashlib
import posixpath
import zipfile
from collections.abc import Iterator
from io import BytesIO
from pathlib import PurePosixPath
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.markup import parsed

BOOK = (
    "path string, book_id string, title string, author string, cover binary, cover_mime string, error string,"
    " docs array<struct<doc_pos:int,doc_id:string,href:string,epub_types:array<string>,paras:array<struct<kind:string,text:string>>>>,"
    " toc array<struct<toc_pos:int,title:string,href:string,depth:int>>"
)


def _name(el: ET.Element) -> str:
    return el.tag.rpartition("}")[2]


def _all(el: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in el.iter() if _name(e) == name]


def _text(el: ET.Element) -> str:
    return " ".join("".join(el.itertext()).split())


def _ncx(points: ET.Element, base: str, depth: int = 1) -> Iterator[tuple[str, str, int]]:
    for p in points:
        if _name(p) != "navPoint":
            continue
        label = next((_text(x) for x in p if _name(x) == "navLabel"), "")
        src = next((x.get("src", "") for x in p if _name(x) == "content"), "")
        if src:
            yield label, posixpath.join(base, unquote(src)), depth
        yield from _ncx(p, base, depth + 1)


def _nav(items: ET.Element, base: str, depth: int = 1) -> Iterator[tuple[str, str, int]]:
    for li in items:
        if _name(li) != "li":
            continue
        label = next((x for x in li if _name(x) in ("a", "span")), None)
        if label is not None and label.get("href"):
            yield _text(label), posixpath.join(base, unquote(label.get("href"))), depth
        for nested in li:
            if _name(nested) == "ol":
                yield from _nav(nested, base, depth + 1)


def read_book(content: bytes, stem: str) -> dict:
    """Title, author, cover, spine documents with their paragraphs, and the flattened contents of one file."""
    z = zipfile.ZipFile(BytesIO(content))
    container = ET.fromstring(z.read("META-INF/container.xml"))
    opf_path = _all(container, "rootfile")[0].get("full-path")
    opf, root = ET.fromstring(z.read(opf_path)), posixpath.dirname(opf_path)
    at = lambda href: posixpath.normpath(posixpath.join(root, unquote(href)))
    manifest = {i.get("id"): i for i in _all(opf, "item")}
    names = set(z.namelist())
    docs = []
    for ref in _all(opf, "itemref"):
        item = manifest.get(ref.get("idref"))
        if item is None or "html" not in item.get("media-type", "") or at(item.get("href", "")) not in names:
            continue
        paras, types = parsed(z.read(at(item.get("href"))).decode("utf-8", "replace"))
        docs.append({"doc_pos": len(docs), "doc_id": item.get("id"), "href": unquote(item.get("href")), "epub_types": types, "paras": [{"kind": k, "text": t} for t, k in paras]})
    toc: list[tuple[str, str, int]] = []
    spine = _all(opf, "spine")
    ncx = manifest.get(spine[0].get("toc", "")) if spine else None
    ncx = ncx if ncx is not None else next((i for i in manifest.values() if "dtbncx" in i.get("media-type", "")), None)
    nav = next((i for i in manifest.values() if "nav" in (i.get("properties") or "").split()), None)
    if ncx is not None and at(ncx.get("href")) in names:
        maps = _all(ET.fromstring(z.read(at(ncx.get("href")))), "navMap")
        toc = list(_ncx(maps[0], posixpath.dirname(ncx.get("href")))) if maps else []
    if not toc and nav is not None and at(nav.get("href")) in names:
        tree = ET.fromstring(z.read(at(nav.get("href"))))
        lists = [e for n in _all(tree, "nav") if "toc" in (n.get("{http://www.idpf.org/2007/ops}type") or "toc").split() for e in n if _name(e) == "ol"]
        toc = list(_nav(lists[0], posixpath.dirname(nav.get("href")))) if lists else []
    title = next((t for e in _all(opf, "title") if (t := _text(e))), "") or stem
    author = next((t for e in _all(opf, "creator") if (t := _text(e))), None)
    cover, mime = _cover(opf, manifest, lambda i: z.read(at(i.get("href"))) if at(i.get("href", "")) in names else None)
    return {
        "book_id": hashlib.sha256(content).hexdigest(), "title": title, "author": author, "cover": cover, "cover_mime": mime, "docs": docs,
        "toc": [{"toc_pos": n, "title": t, "href": h, "depth": d} for n, (t, h, d) in enumerate(toc)],
    }


def _cover(opf: ET.Element, manifest: dict, read) -> tuple[bytes | None, str | None]:
    """The picture marked as the cover, else the one the metadata names, else one whose id says so."""
    images = [i for i in manifest.values() if i.get("media-type", "").startswith("image/")]
    marked = [i for i in images if "cover-image" in (i.get("properties") or "").split()]
    named = [manifest[m.get("content")] for m in _all(opf, "meta") if m.get("name") == "cover" and m.get("content") in manifest]
    for item in [*marked, *named, *(i for i in images if "cover" in (i.get("id") or "").lower())]:
        if data := read(item):
            return data, item.get("media-type")
    return None, None


def _books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    empty = {"book_id": None, "title": None, "author": None, "cover": None, "cover_mime": None, "docs": None, "toc": None}
    for pdf in batches:
        rows = []
        for path, content in pdf[["path", "content"]].itertuples(index=False):
            try:
                rows.append({"path": path, "error": None} | read_book(bytes(content), PurePosixPath(unquote(path)).stem))
            except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ET.ParseError) as e:  # one bad file doesn't stop the others
                rows.append({"path": path, "error": f"{type(e).__name__}: {e}"} | empty)
        yield pd.DataFrame(rows)[["path", "book_id", "title", "author", "cover", "cover_mime", "error", "docs", "toc"]]


def read_epubs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a file: title, author, cover, documents and contents, or the ``error`` that kept it from being read."""
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(_books, BOOK)


def tables(books: DataFrame) -> dict[str, DataFrame]:
    """The tables of the engine from ``read_epubs``; a file that came twice is one book."""
    good = books.where("error is null").dropDuplicates(["book_id"])
    docs = good.select("book_id", F.explode("docs").alias("d"))
    paras = docs.select("book_id", "d.doc_pos", F.posexplode("d.paras").alias("para_pos", "p"))
    return {
        "books": good.select("book_id", "title", "author", "cover", "cover_mime"),
        "spine_docs": docs.select("book_id", "d.doc_pos", "d.doc_id", "d.href", "d.epub_types"),
        "paragraphs": paras.select("book_id", "doc_pos", "para_pos", "p.kind", "p.text"),
        "toc": good.select("book_id", F.explode("toc").alias("t")).select("book_id", "t.*"),
    }
