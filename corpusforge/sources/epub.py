"""EPUB volumes as segments, and EPUB files out of texts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import escape, unescape
from itertools import count, groupby
from posixpath import dirname, join, normpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ATTR = r'\b{0}\s*=\s*"([^"]*)"'


def _attribute(tag: str, name: str) -> str:
    found = re.search(_ATTR.format(name), tag)
    return unescape(found[1]) if found else ""


def segments(data: bytes) -> list[dict]:
    """The navigation points of a volume in reading order: label, file, anchor, parents, html up to the next point.
    Headings that stand at the place of their first entry hold nothing of their own and are told as its parents alone."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf_name = _attribute(z.read("META-INF/container.xml").decode("utf-8", "replace"), "full-path")
        opf = z.read(opf_name).decode("utf-8", "replace")
        base = dirname(opf_name)
        items = {_attribute(t, "id"): normpath(join(base, _attribute(t, "href"))) for t in re.findall(r"<(?:opf:)?item\b[^>]*>", opf)}
        spine = [items[i] for t in re.findall(r"<(?:opf:)?itemref\b[^>]*>", opf) if (i := _attribute(t, "idref")) in items]
        ncx_name = next((n for n in items.values() if n.endswith(".ncx")), None)
        points: list[tuple[str, str, str, list[str]]] = []
        if ncx_name:
            stack: list[str] = []
            for token in re.finditer(r"<navPoint\b|</navPoint>|<text>(.*?)</text>|<content\b[^>]*>", z.read(ncx_name).decode("utf-8", "replace"), re.S):
                if token[0].startswith("<navPoint"):
                    stack.append("")
                elif token[0] == "</navPoint>":
                    stack.pop()
                elif token[0].startswith("<text>") and stack:
                    stack[-1] = unescape(token[1]).strip()
                elif stack:
                    path, _, anchor = _attribute(token[0], "src").partition("#")
                    points.append((stack[-1], normpath(join(dirname(ncx_name), path)), anchor, stack[:-1]))
        texts = {name: z.read(name).decode("utf-8", "replace") for name in spine if name in z.namelist()}
    order = {name: i for i, name in enumerate(spine)}

    def place(file: str, anchor: str) -> tuple[int, int]:
        found = re.search(rf'\b(?:id|name)\s*=\s*"{re.escape(anchor)}"', texts.get(file, "")) if anchor else None
        start = texts[file].rfind("<", 0, found.start()) if found else 0
        return order.get(file, -1), max(start, 0)

    known = [(*place(f, a), label, f, a, parents) for label, f, a, parents in points if f in texts]
    out = []
    for k, (i, at, label, file, anchor, parents) in enumerate(known):
        if k + 1 < len(known) and known[k + 1][:2] == (i, at) and len(known[k + 1][5]) > len(parents):
            continue
        j, until = (known[k + 1][0], known[k + 1][1]) if k + 1 < len(known) else (len(spine) - 1, None)
        parts = []
        for n in range(i, j + 1):
            text = texts.get(spine[n], "")
            parts.append(text[at if n == i else 0 : until if n == j else None])
        out.append({"label": label, "file": file, "anchor": anchor, "parents": parents, "html": "".join(parts)})
    return out


def read_epubs(spark: SparkSession, path: str, volume: str = r"(\d+)") -> DataFrame:
    """label, file, anchor, parents, vol (from the file's name), html of every segment of the volumes at ``path``."""
    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", rf"{volume}[^/]*\.epub$", 1).alias("v"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for v, content in zip(part["v"], part["content"], strict=True):
                if found := segments(bytes(content)):
                    yield pd.DataFrame(found).assign(vol=int(v) if v else None)[["label", "file", "anchor", "parents", "vol", "html"]]

    return files.mapInPandas(run, "label string, file string, anchor string, parents array<string>, vol int, html string")


def _contents(works: list[dict], levels: tuple[str, ...] = ("section", "period"), at: int = 0) -> list[tuple[str | None, int | list]]:
    """The table of contents: (heading, entries) for each run of works with one heading of a level, below the last
    level (None, number of the work). Works without a heading stand a level higher."""
    if not levels:
        return [(None, at + i) for i in range(len(works))]
    out: list[tuple[str | None, int | list]] = []
    for head, run in groupby(works, key=lambda w: w.get(levels[0]) or None):
        held = list(run)
        inner = _contents(held, levels[1:], at)
        out += [(str(head), inner)] if head else inner
        at += len(held)
    return out


def write_epub(path: str, title: str, works: list[dict], identifier: str) -> None:
    """A book of works (section, period, title, text) in their order, on the driver; its contents are nested by section
    and period, by runs of works that share them."""
    chapters = []
    for i, w in enumerate(works):
        body = "".join(f"<p>{'<br/>'.join(escape(x) for x in p.split(chr(10)))}</p>" for p in re.split(r"\n{2,}", w["text"]) if p.strip())
        chapters.append((f"c{i}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(w["title"])}</title></head><body><h1>{escape(w["title"])}</h1>{body}</body></html>'))
    order = count(1)

    def first(entry: int | list) -> int:
        return entry if isinstance(entry, int) else first(entry[0][1])

    def listed(entries: list) -> str:
        rows = (f"<li><span>{escape(head)}</span><ol>{listed(inner)}</ol></li>" if head else f'<li><a href="c{inner}.xhtml">{escape(works[inner]["title"])}</a></li>' for head, inner in entries)
        return "".join(rows)

    def pointed(entries: list) -> str:
        out = []
        for head, inner in entries:
            k, label = next(order), head or works[inner]["title"]
            out.append(f'<navPoint id="n{k}" playOrder="{k}"><navLabel><text>{escape(label)}</text></navLabel><content src="c{first(inner)}.xhtml"/>{pointed(inner) if head else ""}</navPoint>')
        return "".join(out)

    contents = _contents(works)
    nav, points = listed(contents), pointed(contents)
    items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, (n, _) in enumerate(chapters))
    refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OEBPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(identifier)}</dc:identifier><dc:title>{escape(title)}</dc:title></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{refs}</spine></package>')
        z.writestr("OEBPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><navMap>{points}</navMap></ncx>')
        z.writestr("OEBPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>')
        for name, body in chapters:
            z.writestr(f"OEBPS/{name}", body)
