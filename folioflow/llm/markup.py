"""Problem 3: markup left in texts.

Method: union-free regular-expression inference. Every text becomes a stream of control signs (tags, entities, signs of
Markdown, wiki text and LaTeX) and text slots. The streams of one host, which is the way its documents came in, are taken
one after another, the commonest first: one that a wrapper of the host makes counts for it; one that shares most of its
signs with a wrapper is aligned with it, the odd part becoming optional, or a repeated group when it continues what stands
before it; any other starts a wrapper. A text holds markup if wrappers that ``LEAST_TEXTS`` different texts of
its host stand behind make its stream, one or several in a chain, sign by sign in order. Signs no such wrapper makes belong to the printed line and stay.
Texts with markup come out as blocks of a kind (heading, list, code, formula, row, quote, body).

Null and empty texts are no case and give no block; repeated rows count once; texts are read whole."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import cut, known_rows, spread

# Names of HTML elements.
TAGS = (
    "a abbr acronym address article aside b base basefont bdi bdo big blockquote body br caption center cite code col colgroup dd del dfn dir div dl dt em embed"
    " figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main map mark math menu meta nav noscript"
    " nowiki object ol option p param pre q ref references rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table"
    " tbody td textarea tfoot th thead time title tr tt u ul var video wbr"
)
LEAST_TEXTS = 2  # different texts of a host that must stand behind a wrapper: a text alone doesn't support itself
ALIKE = 0.6  # share of the longer of two streams that must be common for one wrapper to take both
PART = 2000  # different streams of a host that one task folds into wrappers; the parts' wrappers are then merged

#: Control signs in the order they are tried; a sign that holds code, a formula or an address is one token.
_SIGNS = rf"""
(?P<comment><!--.*?(?:-->|\Z))
|(?P<doctype><!\[CDATA\[|\]\]>|<!DOCTYPE[^>]*>|<\?xml[^>]*>)
|(?P<tag></?(?:{"|".join(TAGS.split())})(?:\s+[\w:-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?)*\s*/?(?:>|\Z))
|(?P<entity>&(?:\#\d{{1,7}}|\#[xX][0-9A-Fa-f]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,31}});)
|(?P<fence>^```[\w-]*[ ]*$|^~~~[\w-]*[ ]*$)
|(?P<verbatim>\\begin\{{(?:verbatim|lstlisting)\*?\}}.*?\\end\{{(?:verbatim|lstlisting)\*?\}})
|(?P<display>\\\[.*?\\\]|\$\$[^$]+\$\$|\\begin\{{(?:equation|align|displaymath|math|eqnarray)\*?\}}.*?\\end\{{(?:equation|align|displaymath|math|eqnarray)\*?\}})
|(?P<math>\\\(.*?\\\)|(?<![\\\w$])\$(?![\s\d])[^$\n]*?(?<!\s)\$(?![\d\w])|(?<![\\\w$])\$\d[^$\n]*[\\^_=][^$\n]*\$(?![\d\w]))
|(?P<tick>`[^`\n]+`)
|(?P<image>!\[[^\[\]\n]*\]\([^)\n]*\)(?:\{{[^}}\n]*\}})?)
|(?P<mdlink>\[[^\[\]\n]*\]\([^)\s]+(?:\s+"[^"]*")?\)|\[[^\[\]\n]+\]\[[\w-]*\](?!\w)|^\[[^\[\]\n^]+\]:\s+\S+|<https?://[^>\s]+>)
|(?P<mdnote>\[\^[\w-]+\]:?)
|(?P<attr>\{{[\#.][\w-]+(?:\s[^}}\n]*)?\}})
|(?P<mdhead>^[ ]{{0,3}}\#{{1,6}}[ ]+(?=\S)|(?<=\S)[ ]+\#{{1,6}}[ ]*$)
|(?P<wikihead>^={{1,6}}[ ]*(?=[^=\s])(?=[^\n]*[^=\s][ ]*={{1,6}}[ ]*$)|(?<=[^=\s])[ ]*={{1,6}}[ ]*$)
|(?P<setext>(?<=\S\n)(?:={{2,}}|-{{2,}})[ ]*$)
|(?P<mdrow>^\|(?![-}}+]).*\|[ ]*$|^\|?[ ]*:?-{{3,}}:?[ ]*(?:\|[ ]*:?-{{3,}}:?[ ]*)+\|?[ ]*$)
|(?P<wikitable>^\{{\|.*$|^\|\}}|^\|-.*$|^\|\+)
|(?P<wikilink>\[\[|\]\])
|(?P<template>\{{\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}}\}}|\{{\{{|\}}\}})
|(?P<extlink>\[(?:https?|ftp)://[^\s\[\]]+(?:[ ][^\[\]\n]*)?\])
|(?P<magic>__[A-Z]{{3,}}__)
|(?P<quotes>'{{2,5}}(?=[^'\s])(?=(?:[^\n']|'(?!'))*[^\s']'{{2,5}}(?!'))|(?<=[^\s'])'{{2,5}}(?!'))
|(?P<texquote>``(?=[^`]*''))
|(?P<accent>\\['`^"~=.cvHukrdb](?:\{{\\?\w{{1,2}}\}}|[A-Za-z](?![A-Za-z])|\\[ij]\b))
|(?P<command>\\(?:begin|end)\{{[\w*]+\}}|\\[A-Za-z]{{2,}}\*?(?:\[[^\[\]\n]*\])?\{{?|\\[A-Za-z](?=\{{)|\\(?:dots|ldots|item|par|S|P|o|O|ss|ae|oe|aa|l|L)\b)
|(?P<escape>\\[&%$\#_{{}}*`\[\]~,;/@-]|\\\\(?=\s|\Z|\[))
|(?P<strong>\*\*(?=[^\s*])(?=[^*]*[^\s*]\*\*)|(?<=[^\s*])\*\*(?!\*)|__(?=[^\s_])(?=[^_\n]*[^\s_]__(?!\w))|(?<=[^\s_])__(?!\w)|~~)
|(?P<emphasis>(?<![\w*\\])\*(?=[^\s*\d])[^*\n]{{1,200}}?(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]{{1,200}}?(?<=[^\s_])_(?![\w_]))
|(?P<quoteline>^>[ ](?=\S))
|(?P<item>^[ ]{{0,3}}(?:[*+-]|\d{{1,3}}[.)])[ ]+(?=\S))
|(?P<wikiitem>^(?:[*\#:;]{{1,4}})[ ]?(?=\[\[))
|(?P<comment_line>^%[^\n]*$)
"""
SIGNS = re.compile(_SIGNS, re.VERBOSE | re.MULTILINE | re.DOTALL | re.IGNORECASE)
_DRIVE = re.compile(r"\b[A-Za-z]:\\[^\s,;]+")
_ORNAMENT = re.compile(r"[\s*\-–—=~_#.•·◦†‡§❦☙]*\Z")
LINE_SIGNS = frozenset(("item", "quoteline", "comment_line", "wikiitem", "setext"))
#: Signs whose halves look like plain marks: they count only with their partner.
PAIRED = {"wikilink": ("[[", "]]"), "strong": None, "quotes": None}


def signs(text: str) -> list[tuple[str, int, int]]:
    """Control signs of ``text`` as (kind, start, end), in order. Signs that belong to the printed line are left out."""
    if not text or _ORNAMENT.match(text):
        return []
    drives = [m.span() for m in _DRIVE.finditer(text)] if ":\\" in text else []
    found = []
    for m in SIGNS.finditer(text):
        kind, a, b = m.lastgroup, m.start(), m.end()
        if any(x <= a < y for x, y in drives):
            continue
        if kind == "entity" and m[0][1] != "#" and m[0][1:] not in html.entities.html5:
            continue
        if kind == "item" and _ORNAMENT.match(text[a : (text + "\n").index("\n", a)]):
            continue
        found.append((kind, a, b))
    kinds = {k for k, _, _ in found}
    firm = kinds - LINE_SIGNS
    lines = text.count("\n") + 1
    kept = []
    for kind, a, b in found:
        if kind == "item":
            same = [x for x in found if x[0] == "item"]
            dashed = text[a:b].strip()
            if not (firm or len(same) >= 2 and len(same) * 2 >= lines or dashed in ("*", "+") and a == 0):
                continue
            if dashed[0].isdigit() and not firm and len(same) < 2:
                continue
        elif kind == "quoteline":
            if not text.startswith(">") and not firm:
                continue
        elif kind == "comment_line":
            if not firm & {"command", "display", "math", "verbatim", "accent"}:
                continue
        elif kind == "wikihead" and text[a:b].strip("= ") == "" and not re.search(r"^={1,6}[ ]*[^=\s]", text[text.rfind("\n", 0, a) + 1 :]):
            continue
        elif kind in ("strong", "quotes", "wikilink"):
            if sum(k == kind for k, _, _ in found) < 2 and not (kind == "wikilink"):
                continue
        kept.append((kind, a, b))
    return kept


# ---- wrappers -------------------------------------------------------------------------------------------------------

TEXT = "#text"
Wrapper = tuple  # items: a sign class, TEXT, ("?", items) or ("+", items)


def stream(text: str) -> list[str]:
    """The text as a stream of sign classes and text slots. Attributes, addresses and contents don't count."""
    out, at = [], 0
    for kind, a, b in signs(text):
        if text[at:a].strip():
            out.append(TEXT)
        out.append(_class(kind, text[a:b]))
        at = b
    if text[at:].strip():
        out.append(TEXT)
    return out


def _class(kind: str, sign: str) -> str:
    if kind == "tag":
        m = re.match(r"<(/?)(\w+)", sign)
        return f"<{m[1]}{m[2].lower()}>"
    if kind == "entity":
        return "&"
    if kind in ("command", "accent"):
        return re.match(r"\\(?:begin\{\w+|end\{\w+|[A-Za-z]+|.)", sign)[0]
    if kind == "wikilink":
        return sign
    return kind


def folded(items: list) -> Wrapper:
    """Repeats of one group right after another become one repeated group; shortest groups first."""
    items = list(items)
    for width in range(1, 13):
        i, out = 0, []
        while i < len(items):
            group = items[i : i + width]
            j = i + width
            while len(group) == width and items[j : j + width] == group:
                j += width
            bare = group[0][1] if width == 1 and isinstance(group[0], tuple) and group[0][0] == "+" else None
            if len(group) == width and j > i + width and group != [TEXT]:
                out.append(("+", tuple(bare) if bare else tuple(group)))
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    # a group that continues the repeated group before it belongs to it
    return tuple(items)


def align(a: Wrapper, b: Wrapper) -> Wrapper | None:
    """The wrapper of both, or None where they share too little: a longest common alignment whose gaps become optional."""
    a, b = list(a), list(b)
    n, m = len(a), len(b)
    plain = lambda x: x[1] if isinstance(x, tuple) else (x,)
    same = lambda x, y: x == y or plain(x) == plain(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if same(a[i], b[j]) else 0)
    if best[0][0] < ALIKE * max(n, m) or not (_flat(tuple(a)) & _flat(tuple(b)) - {TEXT}):
        return None
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and same(a[i], b[j]):
            x, y = a[i], b[j]
            mark = {z[0] for z in (x, y) if isinstance(z, tuple)}
            out.append(x if x == y else ("?" if "?" in mark else "+", plain(x)))
            i, j = i + 1, j + 1
            continue
        gap = []
        if j < m and (i == n or best[i][j + 1] >= best[i + 1][j]):
            gap, j = [b[j]], j + 1
        else:
            gap, i = [a[i]], i + 1
        x = gap[0]
        if isinstance(x, tuple) and x[0] == "?":
            out.append(x)
        elif out and isinstance(out[-1], tuple) and out[-1] == ("+", plain(x)):
            continue
        else:
            out.append(("?", (x,)))
    return tuple(out)


def accepts(wrapper: Wrapper, stream: Wrapper) -> bool:
    """Whether ``wrapper`` makes ``stream``, in order and to its end. A repeated group of the stream stands for two rounds."""
    tokens = _unrolled(stream)
    return set(tokens) <= _flat(wrapper) and len(tokens) in _reached(wrapper, tokens, frozenset((0,)))


def _unrolled(items: Wrapper) -> tuple[str, ...]:
    out: list[str] = []
    for x in items:
        out += _unrolled(x[1]) * 2 if isinstance(x, tuple) else (x,)
    return tuple(out)


def _reached(items: Wrapper, tokens: tuple[str, ...], starts: frozenset) -> frozenset:
    """Places of the stream that ``items`` can lead to from ``starts``; all ways are followed at once, so none is gone twice."""
    for x in items:
        if not starts:
            break
        if not isinstance(x, tuple):
            starts = frozenset(i + 1 for i in starts if i < len(tokens) and tokens[i] == x)
        elif x[0] == "?":
            starts |= _reached(x[1], tokens, starts)
        else:
            now = every = _reached(x[1], tokens, starts)
            while now:
                now = _reached(x[1], tokens, now) - every
                every |= now
            starts = every
    return starts


def chained(wrappers: list[Wrapper], stream: Wrapper) -> bool:
    """Whether ``wrappers``, one after another, make ``stream``; two neighbours may share the text between them."""
    tokens = _unrolled(stream)
    own = [w for w in wrappers if _flat(w) & set(tokens) - {TEXT}]
    if not set(tokens) <= frozenset().union(*map(_flat, own)):
        return False
    every: frozenset = frozenset()
    now = frozenset((0,))
    while now:
        every |= now
        ends = frozenset().union(*(_reached(w, tokens, now) for w in own))
        now = (ends | {e - 1 for e in ends if e > 1 and tokens[e - 1] == TEXT}) - every
    return len(tokens) in every


def inferred(streams: list[tuple[Wrapper, int]]) -> list[tuple[Wrapper, int]]:
    """(wrapper, texts) of one host from its (stream or wrapper, texts), the commonest first."""
    made: list[list] = []
    for s, n in sorted(streams, key=lambda x: (-x[1], len(x[0]), str(x[0]))):
        own = _flat(s)
        near = [w for w in made if 2 * len(own & _flat(w[0])) > len(own)]
        hit = next((w for w in near if accepts(w[0], s)), None)
        if hit is None:
            for w in near:
                both = align(w[0], s)
                both = both and folded(both)
                if both and accepts(both, s) and accepts(both, w[0]):
                    w[0], hit = both, w
                    break
        if hit is None:
            made.append([s, n])
        else:
            hit[1] += n
    return [(w, n) for w, n in made]


@cache
def _flat(wrapper: Wrapper) -> frozenset:
    out = set()
    for x in wrapper:
        if isinstance(x, tuple):
            out |= _flat(x[1])
        else:
            out.add(x)
    return frozenset(out)


def _write(wrapper: Wrapper) -> str:
    """Wrapper as text: signs parted by blanks, groups as ( ... )? and ( ... )+."""
    return " ".join(f"( {_write(x[1])} ){x[0]}" if isinstance(x, tuple) else x.replace(" ", "_") for x in wrapper)


@lru_cache(maxsize=20_000)
def _read(text: str) -> Wrapper:
    stack: list[list] = [[]]
    for word in text.split(" "):
        if word == "(":
            stack.append([])
        elif word in (")?", ")+"):
            group = stack.pop()
            stack[-1].append((word[1], tuple(group)))
        elif word:
            stack[-1].append(word)
    return tuple(stack[0])


# ---- blocks ---------------------------------------------------------------------------------------------------------

_BREAKS = re.compile(r"</?(?:p|div|section|article|blockquote|table|tbody|thead|ul|ol|dl|center|figure|body|html|main|header|footer)\b[^>]*>|<hr\b[^>]*>", re.IGNORECASE)
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "c": "\u0327", "=": "\u0304", ".": "\u0307", "v": "\u030c", "H": "\u030b", "u": "\u0306", "k": "\u0328", "r": "\u030a"}
_LETTERS = {"ss": "ß", "o": "ø", "O": "Ø", "ae": "æ", "oe": "œ", "aa": "å", "l": "ł", "L": "Ł", "dots": "…", "ldots": "…", "S": "§", "P": "¶", "textellipsis": "…"}


def _inline(s: str) -> str:
    """A piece of text without inline signs."""
    s = re.sub(r"<!--.*?(?:-->|\Z)", "", s, flags=re.DOTALL)
    s = re.sub(r"!\[([^\[\]\n]*)\]\([^)\n]*\)(?:\{[^}\n]*\})?", r"\1", s)
    s = re.sub(r"\[([^\[\]\n]*)\]\([^)\s]+(?:\s+\"[^\"]*\")?\)", r"\1", s)
    s = re.sub(r"\[\^[\w-]+\]:?", "", s)
    s = re.sub(r"\{[#.][\w-]+(?:\s[^}\n]*)?\}", "", s)
    s = re.sub(r"\[\[(?:File|Image|Category|Datei|Bild|Kategorie|Fichier|Catégorie):[^\]]*\]\]", "", s, flags=re.IGNORECASE)
    s = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", r"\1", s)
    s = re.sub(r"\[(?:https?|ftp)://[^\s\]]+ ?([^\[\]\n]*)\]", r"\1", s)
    s = re.sub(r"\{\{(?:[^{}]|\{[^{}]*\})*\}\}", "", s)
    s = re.sub(r"__[A-Z]{3,}__", "", s)
    s = re.sub(r"'{2,5}(?=[^'\s][^\n]*?'{2,5})|(?<=[^\s'])'{2,5}", lambda m: m[0] if "``" in s and m[0] == "''" else "", s)
    s = re.sub(r"``([^`]*?)''", r"“\1”", s)
    s = re.sub(r"\\(['`^\"~=.cvHukr])\{?\\?([A-Za-z])\}?", lambda m: unicodedata.normalize("NFC", m[2] + _ACCENTS[m[1]]), s)
    for _ in range(3):
        s = re.sub(r"~?\\(?:cite|label|ref|index|pageref|vspace|hspace)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", s)
        s = re.sub(r"\\[A-Za-z]{2,}\*?(?:\[[^\[\]\n]*\])?\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\\([A-Za-z]+)\b ?", lambda m: _LETTERS.get(m[1], "") if m.start() == 0 or s[m.start() - 1] != ":" else m[0], s) if not _DRIVE.search(s) else s
    s = re.sub(r"\\([&%$#_{}*`\[\]~@-])", r"\1", s)
    s = re.sub(r"\\[,;/]|\\\\", " ", s) if not _DRIVE.search(s) else s
    s = re.sub(r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"\1", s, flags=re.DOTALL)
    s = re.sub(r"(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)", r"\1", s)
    s = re.sub(r"(?<![\w*])\*(?=[^\s*\d])([^*\n]+?)(?<=[^\s*])\*(?![\w*])", r"\1", s)
    s = re.sub(r"(?<![\w_])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])", r"\1", s)
    s = re.sub(r"~~(.+?)~~", r"\1", s)
    s = re.sub(r"`([^`\n]+)`", r"\1", s)
    s = SIGNS.sub(lambda m: "" if m.lastgroup == "tag" else m[0], s)
    for _ in range(2):  # entities may have been escaped twice
        s = html.unescape(s)
    s = re.sub(rf"</?(?:{'|'.join(TAGS.split())})(?:\s[^<>]*)?/?>", "", s, flags=re.IGNORECASE)
    return re.sub(r"[ \t\u00a0]*\n[ \t\u00a0]*", "\n", s).strip()


def blocks(text: str, kind: str | None = None) -> list[tuple[str, str]]:
    """(kind, text) blocks of a text; a text without signs is one block of its own kind."""
    if not text or not text.strip():
        return []
    if not signs(text):
        return [(kind or "body", text)]
    text = html.unescape(text) if re.search(r"&lt;/?[a-z]\w*", text) else text
    out: list[tuple[str, str]] = []

    def put(k: str, s: str) -> None:
        s = s if k in ("code", "formula") else _inline(s)
        if s.strip():
            out.append((k, s.strip("\n") if k == "code" else s.strip()))

    units = re.compile(
        r"(?P<fence>^(?:```|~~~)[^\n]*\n(?P<fc>.*?)^(?:```|~~~)[ ]*$)|(?P<pre><pre\b[^>]*>(?:\s*<code\b[^>]*>)?(?P<pc>.*?)(?:</code>\s*)?</pre>)"
        r"|(?P<verb>\\begin\{(?:verbatim|lstlisting)\*?\}\n?(?P<vc>.*?)\\end\{(?:verbatim|lstlisting)\*?\})"
        r"|(?P<disp>\\\[(?P<d1>.*?)\\\]|\$\$(?P<d2>[^$]+)\$\$|\\begin\{(?P<env>equation|align|displaymath|eqnarray)\*?\}(?P<d3>.*?)\\end\{(?P=env)\*?\})"
        r"|(?P<h><h[1-6]\b[^>]*>(?P<hc>.*?)</h[1-6]>)|(?P<li><li\b[^>]*>(?P<lc>.*?)(?=</?li\b|</[uo]l>|\Z))|(?P<tr><tr\b[^>]*>(?P<tc>.*?)(?=</?tr\b|</table>|\Z))"
        r"|(?P<sec>\\(?:chapter|section|subsection|subsubsection|part|paragraph|title)\*?\{(?P<sc>(?:[^{}]|\{[^{}]*\})*)\}(?:\\label\{[^}]*\})?)"
        r"|(?P<item>^\s*\\item\b[ ]*(?P<ic>[^\n]*))|(?P<env2>\\(?:begin|end)\{[^}]*\})|(?P<wt>^\{\|.*?^\|\})",
        re.MULTILINE | re.DOTALL | re.IGNORECASE,
    )
    at = 0
    for m in units.finditer(text):
        _lines(text[at : m.start()], kind, put)
        at = m.end()
        if m["fence"] or m["pre"] or m["verb"]:
            put("code", html.unescape(m["fc"] or m["pc"] or m["vc"] or ""))
        elif m["disp"]:
            put("formula", re.sub(r"\\label\{[^}]*\}", "", m["d1"] or m["d2"] or m["d3"] or "").strip())
        elif m["h"] or m["sec"]:
            put("heading", m["hc"] or m["sc"] or "")
        elif m["li"] or m["item"]:
            put("list", m["lc"] or m["ic"] or "")
        elif m["tr"]:
            put("row", ", ".join(_inline(c) for c in re.split(r"</?t[dh]\b[^>]*>", m["tc"]) if _inline(c)))
        elif m["wt"]:
            for row in re.split(r"^\|-.*$", m["wt"], flags=re.MULTILINE):
                cells = [c for line in row.split("\n") if line[:1] in "|!" and line[:2] not in ("|}", "|+") for c in re.split(r"\|\||!!", line[1:])]
                put("row", ", ".join(_inline(c) for c in cells if _inline(c)))
    _lines(text[at:], kind, put)
    return out


def _lines(text: str, kind: str | None, put) -> None:
    """Blocks of a stretch without nested structure: Markdown and wiki lines, the rest by blank lines and block tags."""
    body: list[str] = []

    def flush() -> None:
        if body:
            put(kind or "body", "\n".join(body))
            body.clear()

    text = _BREAKS.sub("\n\n", text)
    text = re.sub(r"<br\s*/?>", "\n", text, flags=re.IGNORECASE)
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if not line.strip():
            flush()
        elif m := re.match(r" {0,3}#{1,6} +(.*?)(?: +#+)? *\Z", line):
            flush()
            put("heading", m[1])
        elif m := re.match(r"(={1,6}) *([^=].*?) *\1 *\Z", line):
            flush()
            put("heading", m[2])
        elif re.match(r"(?:={2,}|-{2,}) *\Z", line) and body:
            put("heading", body.pop())
            flush()
        elif re.match(r"\|?[ ]*:?-{3,}:?[ ]*(?:\|[ ]*:?-{3,}:?[ ]*)+\|?[ ]*\Z", line):
            continue
        elif re.match(r"\|.*\| *\Z", line):
            flush()
            put("row", ", ".join(c.strip() for c in line.strip().strip("|").split("|") if c.strip()))
        elif m := re.match(r" {0,3}(?:[*+-]|\d{1,3}[.)]|[*#:;]{1,4}) *(?=\S)(.*)", line) if re.match(r" {0,3}(?:[*+-]|\d{1,3}[.)]) +\S|[*#:;]{1,4} ?\S", line) and not re.match(r"\*\*\S", line) else None:
            flush()
            put("list", m[1])
        elif m := re.match(r"> ?(.*)", line):
            put("quote", m[1])
        elif re.match(r"%", line) and "\\" in text + line:
            continue
        else:
            body.append(line)
    flush()


# ---- over tables ----------------------------------------------------------------------------------------------------


def _streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        each = map(stream, pdf["text"])
        made = [_write(folded(s)) if any(x != TEXT for x in s) else None for s in each]
        yield pdf.assign(stream=made)[lambda x: x["stream"].notna()].drop(columns="text")


def _infer_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wrappers of each run of equal (host, part); the input is sorted by them, one run is held at a time."""
    now, own = None, []
    names = ["host", "stream", "texts"]
    for pdf in batches:
        out: list[tuple[str, str, int]] = []
        for host, part, s, n in pdf[["host", "part", "stream", "texts"]].itertuples(index=False):
            if (host, part) != now:
                out += [(now[0], _write(w), k) for w, k in inferred(own)] if now else []
                now, own = (host, part), []
            own.append((_read(s), n))
        if out:
            yield pd.DataFrame(out, columns=names)
    if now:
        yield pd.DataFrame([(now[0], _write(w), k) for w, k in inferred(own)], columns=names)


def streams(items: DataFrame) -> DataFrame:
    """``items`` (id, text, further columns) with at least one control sign: their columns without ``text``, its hash ``th`` and
    its ``stream``, in which repeats are folded."""
    own = items.where(F.col("text").isNotNull()).withColumn("th", F.xxhash64("text"))
    # texts without any of these characters can't hold a sign
    own = own.where(F.col("text").rlike(r"[<&\\$`*_\[{=|>#+~]|''|(?m)^\s{0,3}(?:-|\d{1,3}[.)]) |--"))
    kept = ", ".join(f"{c} {kind}" for c, kind in own.dtypes if c != "text")
    return own.mapInPandas(_streams, f"{kept}, stream string")


def distinct_streams(found: DataFrame) -> DataFrame:
    """(host, stream, texts): every stream of a host and how many different texts have it, from ``found`` (host, stream, th)."""
    known = found.select(F.coalesce("host", F.lit("")).alias("host"), "stream", "th").distinct()
    return known.groupBy("host", "stream").agg(F.count("*").alias("texts"))


def wrappers(distinct: DataFrame) -> DataFrame:
    """(host, wrapper, texts) inferred from ``distinct_streams``; those of a host are folded in parts, the parts' wrappers then merged."""
    of = "host string, stream string, texts long"
    parts = distinct.groupBy("host").agg(F.ceil(F.count("*") / PART).alias("parts"))
    split = distinct.join(F.broadcast(parts), "host").withColumn("part", F.pmod(F.xxhash64("stream"), F.col("parts")))
    part = spread(split, "host", "part").sortWithinPartitions("host", "part").select("host", "part", "stream", "texts").mapInPandas(_infer_sorted, of)
    whole = spread(part.withColumn("part", F.lit(0)), "host").sortWithinPartitions("host").select("host", "part", "stream", "texts")
    return whole.mapInPandas(_infer_sorted, of).withColumnRenamed("stream", "wrapper")


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = [chained([_read(w) for w in ws], _read(s)) for s, ws in zip(pdf["stream"], pdf["wrappers"], strict=True)]
        yield pdf.loc[keep, ["host", "stream"]]


def supported(distinct: DataFrame) -> DataFrame:
    """(host, stream) of the ``distinct_streams`` that wrappers of their host with ``LEAST_TEXTS`` texts behind each make, one or several in a chain."""
    strong = wrappers(distinct).where(F.col("texts") >= LEAST_TEXTS).groupBy("host").agg(F.collect_set("wrapper").alias("wrappers"))
    return distinct.join(F.broadcast(strong), "host").select("host", "stream", "wrappers").mapInPandas(_judged, "host string, stream string")


def marked(found: DataFrame) -> DataFrame:
    """``found`` (``streams`` with a ``host``) without those whose stream no supported wrapper of their host makes.

    Only the different streams of a host are matched; what is decided goes back to the texts by host and stream."""
    found = cut(found.withColumn("host", F.coalesce("host", F.lit(""))))
    return known_rows(found, supported(cut(distinct_streams(found))), "host", "stream", how="left_semi")


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, kind, text, markup in pdf.itertuples(index=False):
            each = blocks(text, kind) if markup else [(kind or "body", text)] if text.strip() else []
            rows += [(i, k, b, t) for k, (b, t) in enumerate(each)]
        yield pd.DataFrame(rows, columns=["id", "block_idx", "kind", "text"])


def cleaned(items: DataFrame, held: DataFrame) -> DataFrame:
    """(id, block_idx, kind, text): every item (id, kind, text) as blocks. Items in ``held`` (id), as ``marked`` gives them, come
    out clean; all others keep their text, with whatever signs are printed in it, and their kind."""
    own = items.select("id", "kind", "text").where(F.col("text").isNotNull()).dropDuplicates(["id"])
    told = known_rows(own, held.select("id").distinct().withColumn("markup", F.lit(True)), "id", how="left")
    return told.select("id", "kind", "text", F.coalesce("markup", F.lit(False)).alias("markup")).mapInPandas(_clean, "id long, block_idx int, kind string, text string")
