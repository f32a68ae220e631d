"""Result blocks of stored HTML pages (S4, H1-H6, F44) and two plain extractors (links, title), all native.

A page stays one row until it is split into blocks, so nothing is shuffled: its markup becomes an array of tokens, a fold
over the tags with a stack of open elements gives the elements in question as intervals, and a selector is a test of which interval lies in which.
Pages of plain markup, in which every element ends in its place, are cut by patterns instead, which know elements within elements to a depth and cost a fraction.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class names of the page layout, and elements that have no end tag.
BLOCK = ("gs_r", "gs_or", "gs_scl")
TITLE, INFO, ABSTRACT, PDF = "gs_rt", "gs_a", "gs_rs", "gs_or_ggsm"
CITES, CITES_LOOSE = "cites=", "cites"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
HIDDEN = ("script", "style", "template")

# What an element is to the selectors: bits of its role.
IS_BLOCK, IS_TITLE, IS_INFO, IS_ABSTRACT, IS_PDF, IS_LINK, IS_CITE, IS_CITE_LOOSE = (1 << i for i in range(8))

# A quote counts only behind "=". All loops are possessive, so that none takes stack or steps back.
_IN_TAG = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
_HIDDEN = "|".join(HIDDEN)
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<({_HIDDEN})(?=[\s/>]){_IN_TAG}.*?(?:</\1\s*+>|\z)|<[!?][^>]*+>?|</?[a-z][^\s/>]*+{_IN_TAG}|<?[^<]++|<"
_TAG = rf"(?i)^<(?!(?:{_HIDDEN})[\s/>])/?[a-z]"
_NO_TEXT = rf"(?is)^<(?:[!?]|(?:{_HIDDEN})[\s/>]|/?[a-z].*>\z)"

# Character references: the standard library's table, and what 128 to 159 mean on the web.
_NAMED = {k.rstrip(";") if k.endswith(";") else k: v for k, v in html5.items()}
_SHORT = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))


# Plain markup: lower-case names, attributes in double quotes, every element but ``br`` ended in its place, at most DEPTH within each other.
DEPTH = 12
_ATTRIBUTE = r'\s++%s[a-z][a-z0-9_-]*+(?:="[^"<>]*+")?+(?=[\s>])'
_ATTRIBUTES = rf"(?:{_ATTRIBUTE % ''})*+\s*+"
_UNSEEN = rf"<!--.*?-->|<(?<h%s>{_HIDDEN}){_ATTRIBUTES}>.*?(?i:</\k<h%s>\s*+>)"
_BREAK = r"<br(?:\s*+/)?+>"
_NAME = rf"(?!(?:{'|'.join((*VOID, *HIDDEN))})[\s>])[a-z][a-z0-9]*+"


def _inside(text: str, level: int = 1) -> str:
    """Anything but an end tag; elements with all that is in them."""
    deeper = rf"|<(?<n{level}>{_NAME}){_ATTRIBUTES}>{_inside(text, level + 1)}</\k<n{level}>>" if level <= DEPTH else ""
    return f"(?:{text.replace('%s', str(level))}|{_BREAK}{deeper})*+"


def _rest(level: int = 1) -> str:
    """The same where markup is known to be plain, with the end tag behind it."""
    deeper = f"|<[a-z][^>]*+>{_rest(level + 1)}" if level <= DEPTH else ""
    return f"(?:[^<]++|{_BREAK}{deeper})*+</[^>]++>"


def _with(name: str, value: str) -> str:
    """Attributes of which the first of that name with a value has one that meets ``value``."""
    return rf"""(?:{_ATTRIBUTE % f'(?!{name}=)'})*+\s++{name}="{value}[^>]*+"""


def _classed(*names: str) -> str:
    """An element of plain markup that has all these class names."""
    wanted = "".join(rf'(?=(?:[^"]*[ \t\n\f\r])??{n}[ \t\n\f\r"])' for n in names)
    return rf"(?s)<[a-z][a-z0-9]*+{_with('class', wanted)}>{_rest()}"


def _linked(href: str | None = None) -> str:
    """A link of plain markup, one with ``href`` in its address if that is given."""
    return rf"(?s)<a(?=[\s>]){'[^>]*+' if href is None else _with('href', f'(?=[^"]*{href})')}>{_rest()}"


_SEEN = r"[^<\x00\x01]++"
_PLAIN = rf"(?s)^(?:<!(?:doctype|DOCTYPE)[^<>]*+>)?+{_inside(f'{_SEEN}|{_UNSEEN}')}\z"
#: References that may stand for a part of what is searched for in addresses, or for the mark of a line break.
_REFERENCES = r'(?i)href="[^"]*&(?!amp;)|&#x?0*1(?![0-9a-f])'

def _attribute(tag: Column, name: str) -> Column:
    """The first attribute of that name with a value, quotes kept; empty where there is none."""
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
    others = rf"""(?:[\s/]++|=|(?!{name}[\s=])[^\s=>/]++(?:\s*+=\s*+{value})?+)*+"""
    return F.regexp_extract(tag, rf"(?is)^<[a-z][^\s/>]*+{others}{name}\s*+=\s*+({value})", 1)


def _unquoted(value: Column) -> Column:
    return F.when(value.startswith('"') | value.startswith("'"), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)


def unescaped(text: Column, attribute: bool = False) -> Column:
    """``text`` with its character references resolved; unknown ones stay.

    Names that may stand without a semicolon do so in an ``attribute`` only ahead of something that can't go on with the name or the address.
    """
    behind = "(?![=A-Za-z0-9])" if attribute else ""
    parts = F.regexp_extract_all(text, F.lit(rf"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;|(?:{_SHORT}){behind})|[^&]++|&"), F.lit(0))
    named = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")

    def one(x: Column) -> Column:
        digits = F.regexp_extract(x, "([0-9a-fA-F]+);?$", 1)
        code = F.coalesce(F.when(F.lower(x).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"), F.lit(-1))
        bad = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")
        number = F.when(code.between(128, 159), F.substring(F.lit(_WINDOWS), (code - 127).cast("int"), F.lit(1))).otherwise(point)
        known = F.when(x == "&amp;", "&").when(x == "&lt;", "<").when(x == "&gt;", ">").when(x == "&nbsp;", "\u00a0")
        return F.when(~x.startswith("&"), x).when(known.isNotNull(), known).when(x.startswith("&#"), number).when(x.startswith("&") & (F.length(x) > 1), F.coalesce(named[F.regexp_extract(x, "^&([^;]*)", 1)], x)).otherwise(x)

    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _role(tag: Column) -> Column:
    has = lambda name: tag["classes"].contains(f" {name} ")
    bit = lambda on, value: F.when(on, value).otherwise(0)
    block = has(BLOCK[0]) & has(BLOCK[1]) & has(BLOCK[2])
    classed = bit(block, IS_BLOCK) + bit(has(TITLE), IS_TITLE) + bit(has(INFO), IS_INFO) + bit(has(ABSTRACT), IS_ABSTRACT) + bit(has(PDF), IS_PDF)
    cites = bit(tag["href"].contains(CITES), IS_CITE) + bit(tag["href"].contains(CITES_LOOSE), IS_CITE_LOOSE)
    return F.when(tag["classes"].isNull(), 0).otherwise(classed) + bit(tag["name"] == "a", F.lit(IS_LINK) + cites)


def _tags(tokens: Column) -> Column:
    """Tags of a page: place among the tokens, name, whether they end, need no end, and what they are to the selectors."""
    placed = F.filter(F.transform(tokens, lambda x, i: F.struct(i.alias("at"), x.alias("raw"))), lambda x: x["raw"].startswith("<") & x["raw"].endswith(">") & x["raw"].rlike(_TAG))

    def read(x: Column) -> Column:
        raw, start = x["raw"], ~x["raw"].startswith("</")
        name = F.translate(F.lower(F.regexp_extract(raw, r"^</?([^\s/>]+)", 1)), ":;,=", "____")
        classes = F.when(start & F.lower(raw).contains("class"), F.nullif(_attribute(raw, "class"), F.lit("")))
        href = F.when(start & (name == "a"), F.nullif(_attribute(raw, "href"), F.lit("")))
        return F.struct(x["at"].alias("at"), name.alias("name"), (~start).alias("ends"), raw.endswith("/>").alias("closed"), classes.alias("classes"), href.alias("href"))

    def plain(x: Column) -> Column:
        return F.struct(x["at"].alias("at"), x["name"].alias("name"), x["ends"].alias("ends"), x["closed"].alias("closed"), F.concat(F.lit(" "), F.translate(_unquoted(x["classes"]), "\t\n\f\r", "    "), F.lit(" ")).alias("classes"), unescaped(_unquoted(x["href"]), attribute=True).alias("href"))

    def judged(x: Column) -> Column:
        alone = x["closed"] | x["name"].isin(*VOID)
        return F.struct(x["at"].alias("at"), x["name"].alias("name"), x["ends"].alias("ends"), alone.alias("alone"), F.when(x["ends"], 0).otherwise(_role(x)).alias("role"), x["href"].alias("href"))

    return F.transform(F.transform(F.transform(placed, read), plain), judged)


def _elements(tags: Column, size: Column) -> Column:
    """Elements with a role in document order: own number, number behind the last one inside, first and last token, role, address.

    An end tag closes the nearest open element of its name and all within; without one it does nothing. The page's end closes the rest.
    The fold copies its state at each tag, so open elements (``/name:rank,tag,role``) and closed ones (``;end tag,last=`` and what it closed) are short strings.
    """
    zero = F.struct(F.lit("").alias("open"), F.lit("").alias("done"), F.lit(0).alias("n"), F.lit(0).alias("k"))
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    def step(a: Column, x: Column) -> Column:
        told, mark = x["role"] != 0, said("/", x["name"], ":")
        own = F.when(told, said(a["n"], ",", a["k"], ",", x["role"])).otherwise("")
        inner = F.call_function("substring_index", a["open"], mark, F.lit(-1))
        found = a["open"].contains(mark)
        rest = F.left(a["open"], F.length(a["open"]) - F.length(inner) - F.length(mark))
        return F.struct(
            F.when(x["ends"], F.when(found, rest).otherwise(a["open"])).when(x["alone"], a["open"]).otherwise(said(a["open"], mark, own)).alias("open"),
            F.when(x["ends"] & found & inner.contains(","), said(a["done"], ";", a["k"], ",", a["n"], "=", inner))
            .when(~x["ends"] & x["alone"] & told, said(a["done"], ";", a["k"], ",", a["n"] + 1, "=", own))
            .otherwise(a["done"]).alias("done"),
            (a["n"] + told.cast("int")).alias("n"),
            (a["k"] + 1).alias("k"),
        )

    closed = F.aggregate(tags, zero, step, lambda a: said(a["k"], ",", a["n"], "=", a["open"], a["done"]))

    def spans(group: Column) -> Column:
        stop, last = group["end"][0].cast("int"), group["end"][1].cast("int")

        def span(entry: Column) -> Column:
            tag = F.get(tags, entry[1].cast("int"))
            return F.struct(entry[0].cast("int").alias("rank"), last.alias("last"), tag["at"].alias("at"), F.coalesce(F.get(tags, stop)["at"], size).alias("stop"), tag["role"].alias("role"), tag["href"].alias("href"))

        return F.transform(F.transform(F.filter(F.split(group["inner"], "[/:]"), lambda e: e.contains(",")), lambda e: F.split(e, ",")), span)

    groups = F.transform(F.transform(F.split(closed, ";"), lambda g: F.split(g, "=")), lambda g: F.struct(F.split(g[0], ",").alias("end"), g[1].alias("inner")))
    return F.array_sort(F.flatten(F.transform(groups, spans)))


def _texts(tokens: Column) -> Column:
    """What each token shows: text with white space as spaces, a line break for ``br``, nothing for other markup."""
    shown = lambda x: F.translate(unescaped(x), "\t\n\x0b\f\r\u00a0", " " * 6)
    return F.transform(tokens, lambda x: F.when(~x.startswith("<"), shown(x)).when(x.rlike(r"(?i)^<br[\s/>]"), "\n").when(x.rlike(_NO_TEXT), "").otherwise(shown(x)))


def _marked(element: Column) -> Column:
    """An element of plain markup with marks for tags, which part character references as they part tokens, and for line breaks."""
    broken = F.when(element.contains("<br"), F.regexp_replace(element, F.lit(_BREAK), F.lit("\x01"))).otherwise(element)
    return F.regexp_replace(broken, F.lit("<[^>]*+>"), F.lit("\x00"))


def _shown(marked: Column) -> Column:
    resolved = F.when(~marked.contains("&"), marked).when(marked.rlike("&(?!amp;)"), unescaped(marked)).otherwise(F.replace(marked, F.lit("&amp;"), F.lit("&")))
    return F.translate(resolved, "\t\n\x0b\f\r \x01\x00", " " * 6 + "\n")


def _stripped(shown: Column) -> Column:
    return F.when(shown.contains("\n") | shown.contains("  "), _lined(shown)).otherwise(F.trim(shown))


def _several(block: Column, name: str) -> Column:
    return F.substring_index(block, name, 2) != block


def _lined(text: Column) -> Column:
    """Text without spaces at the ends of lines, without empty lines and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.concat(F.lit("\n"), text, F.lit("\n")), " +", " "), " ?\n[ \n]*", "\n"), F.lit("\n"))


def _behind_tag(element: Column) -> Column:
    return F.substr(element, F.locate(">", element) + 1)


def _address(link: Column) -> Column:
    value = F.regexp_extract(link, rf"""^<a(?:{_ATTRIBUTE % '(?!href=)'})*+\s++href=("[^"<>]*+")""", 1)
    return F.replace(_unquoted(F.nullif(value, F.lit(""))), F.lit("&amp;"), F.lit("&"))


def result_blocks(pages: DataFrame, page_no: str = "page_no", html: str = "html") -> DataFrame:
    """One row per block of each page, ``pos`` from 1; fields that a block lacks are null. A null or blank page has none.

    Of several elements for a field the first counts. Blocks within blocks are rows of their own. Pages that are repeated give their blocks
    again; further columns of ``pages`` are not read. Markup may be broken: elements without an end end with the one around them, comments and scripts show nothing.
    """
    bit = lambda e, value: e["role"].bitwiseAND(value) != 0
    source = pages.select(F.col(page_no).cast("int").alias("page_no"), F.col(html).alias("html"))
    references = F.when(F.replace("html", F.lit("&amp;"), F.lit("")).contains("&"), F.col("html").rlike(_REFERENCES)).otherwise(False)
    plain = F.col("html").rlike(_PLAIN) & ~references
    unseen = F.when(F.col("html").rlike(rf"<(?:!--|{_HIDDEN})"), F.regexp_replace("html", F.lit(f"(?s){_UNSEEN}".replace("%s", "")), F.lit("\x00"))).otherwise(F.col("html"))
    found = source.withColumn("whole", F.when(plain, F.regexp_extract_all(unseen, F.lit(_classed(*BLOCK)), F.lit(0))))
    # the first title or PDF may not be the one with the link, or there is a block inside
    general = F.coalesce(F.exists("whole", lambda b: _several(b, TITLE) | _several(b, PDF) | _several(b, BLOCK[-1])), F.lit(True))
    tokens = found.select("page_no", "whole", F.when(general, F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("tokens"))
    tagged = tokens.withColumn("tags", _tags(F.col("tokens")))
    told = tagged.select("page_no", "whole", "tokens", _elements(F.col("tags"), F.size("tokens")).alias("elements"))
    inside = lambda column, at, size: F.slice(column, at, F.greatest(size, F.lit(0)))
    cut = F.transform(
        F.filter("elements", lambda e: bit(e, IS_BLOCK)),
        lambda b: F.struct(
            F.lit(None).cast("string").alias("whole"),
            (b["at"] + 1).alias("base"),
            inside(F.col("tokens"), b["at"] + 2, b["stop"] - b["at"] - 1).alias("tokens"),
            inside(F.col("elements"), b["rank"] + 2, b["last"] - b["rank"] - 1).alias("elements"),
        ),
    )
    kind = told.select(cut.alias("c")).schema["c"].dataType.elementType
    none = lambda name: F.lit(None).cast(kind[name].dataType).alias(name)
    whole = F.transform("whole", lambda b: F.struct(_behind_tag(b).alias("whole"), none("base"), none("tokens"), none("elements")))
    cut = F.when(F.col("tokens").isNull(), whole).otherwise(cut)
    blocks = told.select("page_no", F.posexplode(cut).alias("pos", "b")).select("page_no", (F.col("pos") + 1).alias("pos"), "b.*")
    shown = blocks.select("page_no", "pos", "whole", "base", "elements", _texts(F.col("tokens")).alias("texts"))

    first = lambda value: F.get(F.filter("elements", lambda e: bit(e, value)), F.lit(0))

    def link_in(value: int) -> Column:
        around = F.filter("elements", lambda e: bit(e, value))
        within = lambda y: F.exists(around, lambda t: (t["rank"] < y["rank"]) & (y["rank"] < t["last"]))
        return F.get(F.filter(F.filter("elements", lambda e: bit(e, IS_LINK)), within), F.lit(0))

    def text(name: str) -> Column:
        e = F.col(name)
        joined = F.array_join(inside(F.col("texts"), e["at"] - F.col("base") + 2, F.when(e.isNotNull(), e["stop"] - e["at"] - 1)), "")
        return F.when(e.isNotNull(), _lined(joined))

    def part(around: Column, pattern: str, name: str) -> Column:
        return F.when(around.contains(name), F.nullif(F.regexp_extract(around, pattern, 0), F.lit("")))

    block = F.col("whole")
    found = {"e_title": link_in(IS_TITLE), "e_info": first(IS_INFO), "e_abstract": first(IS_ABSTRACT), "e_cite": first(IS_CITE), "e_loose": first(IS_CITE_LOOSE), "e_pdf": link_in(IS_PDF)}
    parts = {
        "p_title": part(_behind_tag(part(block, _classed(TITLE), TITLE)), _linked(), "<a"), "p_info": part(block, _classed(INFO), INFO), "p_abstract": part(block, _classed(ABSTRACT), ABSTRACT),
        "p_cite": part(block, _linked(CITES), CITES), "p_loose": part(block, _linked(CITES_LOOSE), CITES_LOOSE), "p_pdf": part(_behind_tag(part(block, _classed(PDF), PDF)), _linked(), "<a"),
    }
    picked = shown.select("page_no", "pos", "whole", "base", "texts", *[v.alias(k) for k, v in (found | parts).items()], _address(parts["p_title"]).alias("a_title"), _address(parts["p_pdf"]).alias("a_pdf"))
    for of in (_marked, _shown, _stripped):  # one after the other, as each reads its text more than once
        picked = picked.withColumns({p: of(F.col(p)) for p in parts})
    either = lambda plain, general, name: F.when(block.isNotNull(), F.col(plain)).otherwise(general).alias(name)
    both = lambda end, name: either(f"p_{end}", text(f"e_{end}"), name)
    return picked.select(
        "page_no",
        "pos",
        both("title", "title"),
        either("a_title", F.col("e_title.href"), "url"),
        both("info", "info"),
        both("abstract", "abstract"),
        both("cite", "cite_text"),
        both("loose", "cite_text_loose"),
        F.coalesce(F.col("p_pdf"), F.col("e_pdf.at").cast("string")).isNotNull().alias("has_pdf_link"),
        either("a_pdf", F.col("e_pdf.href"), "pdf_url"),
    )


def title(html: Column) -> Column:
    """The text of the first title element, tags by pattern (native)."""
    return F.nullif(F.regexp_extract(html, r"<title>([^<]*)</title>", 1), F.lit(""))


def links(html: Column) -> Column:
    """Targets of all ``href`` attributes in document order (native)."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))
