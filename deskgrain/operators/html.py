"""Pages to text: markup is cut into tokens once, and a fold over the few tokens that show or hide text says which runs count.

Tokens are those of the standard library's tolerant parser fed with the whole page: comments, declarations and processing
instructions, start tags (a ``>`` in a quoted value is part of it), end tags, the raw content of scripts and styles, and runs of
text. What is still open at the end of a page (a tag, a comment, a script, a reference) is lost, as it is there.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are replaced when a page becomes plain text.
ONE_TO_ONE = ("’‘“”• ", "''\"\"- ")
DROPPED = "[​‌‍﻿]"
LONGER = {"[–—]": " - ", "→": "->", "←": "<-"}
# Elements whose text is hidden, elements that break lines.
HIDDEN = ("script", "style", "nav", "footer")
BREAKS = ("h1", "h2", "h3", "p", "li", "tr")

#: All that counts as white space where text is split into words.
SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
_ATTRIBUTES = r"""(?:[^>=]++|=++\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+))*+"""
_NAME_ENDS = r"(?=[\t\n\r\f />\x00])"
TOKEN = "|".join(
    (
        r"(?s)<!--.*?--\s*>", r"<!\[(?i:cdata|temp|ignore|include|rcdata)\b.*?\]\s*\]\s*>", r"<(?!!--)[!?][^>]*+>", r"</[^>]*+>",
        rf"<(script|style){_NAME_ENDS}{_ATTRIBUTES}(?<!/)>(?:.*?(?=</\s*\1\s*>)|.*+)", rf"<[a-zA-Z]{_ATTRIBUTES}>",
        r"[^<]++", r"<(?=[^a-zA-Z/!?])", r"<.*+",
    )
)
TOKEN = TOKEN.replace("<(script|style)", "<((?i:script|style))").replace(r"</\s*\1\s*>", r"</\s*(?i:\1)\s*>")
_TAG = r"^<(/?)(?:(?<=/)\s*)?([a-zA-Z][^\t\n\r\f />\x00]*)"
#: A reference that the end of the page may have cut off, and all text from the last markup on with it.
_CUT = r"(?s)&[^\s;&]{0,33}$"

#: What runs of tokens between two changes are: shown, within a title, within a title that is hidden, hidden.
SHOWN, TITLE, HIDDEN_TITLE, GONE = range(4)


def _bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _table(names: dict[str, str]) -> Column:
    """A literal map of maps, by first character and then by name, so that a lookup passes few names."""
    by: dict[str, dict[str, str]] = {}
    for n, v in names.items():
        by.setdefault(n[0], {})[n] = v
    return F.from_json(F.lit(json.dumps(by)), "map<string,map<string,string>>")


def _named(m: Column) -> Column:
    """The text of ``&m``: by its whole name, else by the longest name at its start that needs no semicolon, else itself."""
    every, short = _table(html5), {n: v for n, v in html5.items() if not n.endswith(";")}
    known, early = F.substring(m, 1, 1), _table(short)
    found = [F.try_element_at(F.try_element_at(every, known), m)]
    for size in sorted({len(n) for n in short}, reverse=True):
        start = F.substring(m, 1, size)
        value = F.try_element_at(F.try_element_at(early, known), start)
        found.append(F.when(F.length(m) > size, F.concat(value, F.substr(m, F.lit(size + 1)))))
    return F.coalesce(*found, F.concat(F.lit("&"), m))


def _numbered(m: Column) -> Column:
    """The character of ``&m`` for ``#123`` or ``#x1F``: 128 to 159 are those of Windows-1252, what is no character is U+FFFD
    (zero, surrogates, too large) or nothing (other controls, non-characters)."""
    digits, hexes = F.regexp_extract(m, r"^#0*+([0-9]*)", 1), F.regexp_extract(m, r"^#[xX]0*+([0-9a-fA-F]*)", 1)
    is_hex = m.rlike("^#[xX]")
    far = F.lit(0x110000)
    code = F.when(is_hex, F.when(F.length(hexes) > 6, far).otherwise(F.conv(hexes, 16, 10).try_cast("int"))).otherwise(
        F.when(F.length(digits) > 7, far).otherwise(digits.try_cast("int"))
    )
    windows = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]

    def char(c: Column) -> Column:
        c = F.coalesce(c, F.lit(0))
        none = c.between(1, 8) | c.isin(11, 127) | c.between(14, 31) | c.between(0xFDD0, 0xFDEF) | (c.bitwiseAND(0xFFFE) == 0xFFFE)
        return (
            F.when((c == 0) | c.between(0xD800, 0xDFFF) | (c > 0x10FFFF), "\ufffd")
            .when(c.between(128, 159), F.get(F.array(*map(F.lit, windows)), c - 128)).when(none, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))
        )

    return _bound(code, char)


def unescaped(text: Column) -> Column:
    """Text with all named and numeric character references replaced, in one pass."""
    reference = r"^&(#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32};?)"

    def piece(p: Column) -> Column:
        def by(m: Column) -> Column:
            rest = F.substr(p, F.length(m) + 2)
            return F.when(m == "", p).when(m.startswith("#"), F.concat(_numbered(m), rest)).otherwise(F.concat(_named(m), rest))

        return F.when(p.startswith("&"), _bound(F.regexp_extract(p, reference, 1), by)).otherwise(p)

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "(?=&)"), piece), "")).otherwise(text)


def tokens(html: Column) -> Column:
    """The tokens of a page in order; text that is lost at its end is not among them."""
    every = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0))

    def without_loss(t: Column) -> Column:
        last = F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit(""))
        lost = F.when(last.startswith("<"), (last == "<") | (last.rlike("^<[a-zA-Z/!?]") & ~last.rlike(r"(?s)^<[^<]*>$|--\s*>$"))).otherwise(
            last.rlike(_CUT)
        )
        return F.when(lost, F.slice(t, 1, F.size(t) - 1)).otherwise(t)

    return _bound(every, without_loss)


def _is_text(t: Column) -> Column:
    return ~t.rlike("^<[a-zA-Z/!?]")


def _runs(t: Column) -> Column:
    """Runs of tokens (at, many, mode) between the tags that change what is shown. Each hidden element counts, nested ones too;
    an end tag closes one, whichever it names, and none if none is open."""
    of_interest = rf"(?i)^</?\s*(title|{'|'.join(HIDDEN)}){_NAME_ENDS}"
    marks = F.filter(F.transform(t, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda m: m["x"].rlike(of_interest))
    facts = F.transform(
        marks,
        lambda m: F.struct(
            m["i"].alias("i"), m["x"].startswith("</").alias("ends"), m["x"].rlike(rf"(?i)^</?\s*title{_NAME_ENDS}").alias("title"),
            m["x"].rlike(r"/>$").alias("both"),
        ),
    )
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("title"),
        F.array().cast("array<struct<at:int,many:int,mode:int>>").alias("runs"),
    )

    def mode(depth: Column, title: Column) -> Column:
        return F.when(title, F.when(depth > 0, HIDDEN_TITLE).otherwise(TITLE)).otherwise(F.when(depth > 0, GONE).otherwise(SHOWN))

    def run(acc: Column, upto: Column) -> Column:
        made = F.struct(acc["at"].alias("at"), (upto - acc["at"]).alias("many"), mode(acc["depth"], acc["title"]).alias("mode"))
        return F.when(upto > acc["at"], F.array_append(acc["runs"], made)).otherwise(acc["runs"])

    def step(acc: Column, m: Column) -> Column:
        # a tag that opens and closes at once changes nothing but closes a title
        ends = m["ends"] | m["both"]
        depth = F.when(m["title"] | (m["both"] & ~m["ends"]), acc["depth"]).when(ends, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(
            acc["depth"] + 1
        )
        title = F.when(m["title"], ~ends).otherwise(acc["title"])
        same = mode(depth, title) == mode(acc["depth"], acc["title"])
        return F.struct(
            F.when(same, acc["at"]).otherwise(m["i"]).alias("at"), depth.alias("depth"), title.alias("title"),
            F.when(same, acc["runs"]).otherwise(run(acc, m["i"])).alias("runs"),
        )

    return F.aggregate(facts, start, step, lambda acc: run(acc, F.size(t)))


def html_page(html: Column, between: str = "") -> Column:
    """(title, body, rejected): visible text of a page, with line breaks at headings, paragraphs, items and rows; rejected below
    five words.

    Each run of text between two tags is trimmed and its white space collapsed; ``between`` stands between two runs of a line.
    Text within navigation, footers, scripts and styles is hidden, however they nest; that of titles goes to the title. Null and
    empty pages have neither and are rejected; markup that never ends is lost; what scripts and styles hold is never text, even
    within a title that was not closed.
    """
    breaks = rf"(?i)^</?\s*({'|'.join(BREAKS)}){_NAME_ENDS}"

    def text(x: Column) -> Column:
        return F.trim(F.regexp_replace(unescaped(x), SPACE, " "))

    def shown(t: Column, r: Column) -> Column:
        part = F.slice(t, r["at"] + 1, r["many"])
        word = F.lit(None).cast("string")
        return F.transform(part, lambda x: F.when(_is_text(x), F.when(r["mode"] == SHOWN, text(x)).otherwise(word)).when(x.rlike(breaks), "\n"))

    def page(t: Column) -> Column:
        def parts(runs: Column) -> Column:
            seen = F.flatten(F.transform(F.filter(runs, lambda r: r["mode"] <= TITLE), lambda r: shown(t, r)))
            named = F.filter(runs, lambda r: r["mode"].isin(TITLE, HIDDEN_TITLE))
            titles = F.flatten(
                F.transform(named, lambda r: F.transform(F.filter(F.slice(t, r["at"] + 1, r["many"]), _is_text), text))
            )
            lines = F.split(F.array_join(F.filter(seen, lambda x: x != ""), between), "\n")
            body = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), "\n")
            title = F.array_join(F.filter(titles, lambda x: x != ""), " ")
            return _bound(
                body,
                lambda b: F.struct(
                    title.alias("title"), b.alias("body"),
                    (F.size(F.filter(F.split(b, "[ \n]+"), lambda w: w != "")) < 5).alias("rejected"),
                ),
            )

        return _bound(_runs(t), parts)

    return _bound(tokens(html), page)


def html_plain(html: Column) -> Column:
    """Plain ASCII text of a page: scripts and styles out, markup by a space, all character references replaced, typographic
    characters by their ASCII kin, white space collapsed. A null page has an empty text."""
    raw = F.array_join(F.transform(tokens(html), lambda x: F.when(_is_text(x), unescaped(x)).otherwise(" ")), "")
    t = F.regexp_replace(F.translate(raw, *ONE_TO_ONE), DROPPED, "")
    for pattern, by in LONGER.items():
        t = F.regexp_replace(t, pattern, by)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\x00-\x7F]", ""), r"[\t-\r\x1C-\x20]+", " "))
