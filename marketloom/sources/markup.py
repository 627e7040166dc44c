"""Rows out of markup: HTML tables (news, calendars, label and value), links, and RSS or Atom feeds.

A page is cut into tags and texts by one expression, and these into table rows and cells where the page stands; a page is
one value of its table, so its tokens are bounded by it.  A window over the page's rows tells in which table each stands.  What follows are groupings and
forward fills of rows.  End tags of cells and rows may be missing; comments, scripts and styles are passed over; a table
inside a cell is a table of its own.  Null and empty pages give no rows; pages with one id stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Comments, scripts and styles, declarations, tags (a quoted ``>`` does not end one), texts; a lone ``<`` is a text.
TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\z)|<![^>]*>|</?[a-z](?:"[^"]*+"|'[^']*+'|[^'">]++)*+>|(?:[^<]++|<(?![a-z/!]))++|<"""
#: Named character references.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "middot": "·", "ndash": "–", "mdash": "—", "hellip": "…"}


def unescape(text: Column) -> Column:
    """Character references as characters: numbers, and the names of ENTITIES."""

    def numbers(t: Column, pattern: str, code) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
        return F.aggregate(found, t, lambda s, ref: F.replace(s, ref, F.coalesce(F.decode(F.unhex(F.lpad(code(ref), 8, "0")), "UTF-32"), ref)))

    plain = text
    text = numbers(text, "&#[0-9]{1,7};", lambda ref: F.hex(F.regexp_extract(ref, "[0-9]+", 0).cast("long")))
    text = numbers(text, "&#[xX][0-9a-fA-F]{1,6};", lambda ref: F.regexp_extract(ref, "[xX]([0-9a-fA-F]+)", 1))
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.when(plain.contains("&"), F.replace(text, F.lit("&amp;"), F.lit("&"))).otherwise(plain)


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not; null without one."""
    found = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.when(found != "", unescape(F.regexp_replace(found, "^[\"']|[\"']$", "")))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def _pieces(items: Column, opens) -> Column:
    """An array cut before each item for which ``opens(item, place)`` holds; what stands before the first is left out."""

    def between(a: Column, at: Column) -> Column:
        ends = F.slice(F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(a) + 1)), 1, F.size(at))
        return F.zip_with(at, ends, lambda p, q: F.slice(a, p, q - p))

    starts = lambda a: F.filter(F.transform(a, lambda x, i: F.when(opens(x, i), i + 1)), lambda p: p.isNotNull())
    return _let(items, lambda a: _let(starts(a), lambda at: between(a, at)))


def _tokens(html: str) -> Column:
    """The tokens of a page, in order: ``tag`` (lower case, ``/`` before an end tag; empty for texts, null for what is passed over) and ``token``."""
    tag = lambda t: F.lower(F.regexp_extract(t, "^<(/?[a-zA-Z][a-zA-Z0-9]*)", 1))
    kind = lambda t: F.when(~t.rlike("^<[a-zA-Z/!]"), "").otherwise(F.nullif(F.nullif(F.nullif(tag(t), F.lit("")), F.lit("script")), F.lit("style")))
    return F.transform(F.regexp_extract_all(F.col(html), F.lit(TOKEN), F.lit(0)), lambda t: F.struct(kind(t).alias("tag"), t.alias("token")))


def _joined(some: Column) -> Column:
    """The texts of some tokens in their order, references replaced, each without white space at its ends."""
    texts = F.transform(F.filter(some, lambda x: x["tag"] == ""), lambda x: S.strip(unescape(x["token"])))
    return F.array_join(F.filter(texts, lambda t: t != ""), "")


def links(pages: DataFrame, html: str = "html", id: str = "page_id") -> DataFrame:
    """``page_id``, ``n`` (from 1 in its page), ``href`` and ``label`` of every anchor."""
    runs = F.filter(_pieces(_tokens(html), lambda x, _: x["tag"].isin("a", "/a")), lambda p: p[0]["tag"] == "a")
    a = pages.select(F.col(id).alias("page_id"), F.posexplode(runs).alias("at", "run"))
    return a.select("page_id", (F.col("at") + 1).alias("n"), attribute(F.col("run")[0]["token"], "href").alias("href"), _joined(F.col("run")).alias("label"))


#: Tags that begin or end a cell.
EDGES = ("td", "th", "/td", "/th", "tr", "/tr", "table", "/table")


def _cell(p: Column) -> Column:
    """A cell of its tokens, the first of which opens it."""
    classes = F.array_join(F.transform(F.filter(p, lambda x: x["tag"] != ""), lambda x: attribute(x["token"], "class")), " ")
    # its first anchor, as far as the next begins or this one ends
    k = F.coalesce(F.array_position(F.transform(p, lambda x: x["tag"]), "a"), F.lit(0)).cast("int")
    after = lambda at: F.slice(p, at + 1, F.size(p))
    end = lambda rest: F.array_position(F.transform(rest, lambda x: F.coalesce(x["tag"].isin("a", "/a"), F.lit(False))), True).cast("int")
    own = lambda at: _let(after(at), lambda rest: _let(end(rest), lambda e: F.when(e > 0, F.slice(rest, 1, F.greatest(e - 1, F.lit(0)))).otherwise(rest)))
    anchor = _let(k, lambda at: F.when(at > 0, F.struct(attribute(F.get(p, at - 1)["token"], "href").alias("href"), _joined(own(at)).alias("label"))))
    return _let(anchor, lambda a: F.struct((p[0]["tag"] == "th").alias("header"), _joined(p).alias("text"), classes.alias("classes"), a["href"].alias("href"), F.coalesce(a["label"], F.lit("")).alias("label")))


def table_rows(pages: DataFrame, html: str = "html", id: str = "page_id") -> DataFrame:
    """One row for each table row that has cells: ``doc`` (a number of the page), ``page_id``, ``tab``, ``tab_id``, ``tab_class``, ``row``, ``place`` (in its
    page) and ``cells``, in order: ``n`` (from 1 in its row), ``header``, ``text``, ``classes`` (of all its tags), and of its first anchor ``href`` and
    ``label``.  Cells are cut out in the page's own row; only they are moved."""
    opens = lambda x, i: (i == 0) | F.coalesce(x["tag"].isin("tr", "table"), F.lit(False))
    numbered = pages.select(F.monotonically_increasing_id().alias("doc"), F.col(id).alias("page_id"), _pieces(_tokens(html), opens).alias("__runs"))  # before the runs are rows
    runs = numbered.select("doc", "page_id", F.posexplode("__runs").alias("place", "run"))
    first = F.col("run")[0]
    table = F.when(first["tag"] == "table", F.struct(attribute(first["token"], "id").alias("id"), attribute(first["token"], "class").alias("class")))
    some = F.filter(_pieces(F.col("run"), lambda x, _: x["tag"].isin(*EDGES)), lambda p: p[0]["tag"].isin("td", "th"))
    r = runs.select("doc", "page_id", "place", first["tag"].alias("tag"), table.alias("table"), F.transform(some, _cell).alias("cells"))
    w = Window.partitionBy("doc").orderBy("place")
    r = r.withColumns({
        "tab": F.count(F.when(F.col("tag") == "table", True)).over(w), "row": F.count(F.when(F.col("tag") == "tr", True)).over(w), "table": F.last("table", ignorenulls=True).over(w),
        "before": F.coalesce(F.sum(F.size("cells")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    # a table that begins inside a row goes on with its numbers
    r = r.withColumn("offset", F.col("before") - F.coalesce(F.last(F.when(F.col("tag") == "tr", F.col("before")), ignorenulls=True).over(w), F.lit(0)))
    placed = F.transform("cells", lambda c, i: F.struct((F.col("offset") + i + 1).cast("int").alias("n"), *[c[x].alias(x) for x in ("header", "text", "classes", "href", "label")]))
    return r.where(F.size("cells") > 0).select("doc", "page_id", "tab", F.col("table.id").alias("tab_id"), F.col("table.class").alias("tab_class"), "row", "place", placed.alias("cells"))


def cells(pages: DataFrame, html: str = "html", id: str = "page_id") -> DataFrame:
    """One row for each cell: the columns of ``table_rows`` without ``place``, and those of a cell."""
    return table_rows(pages, html, id).withColumn("cell", F.explode("cells")).select("doc", "page_id", "tab", "tab_id", "tab_class", "row", "cell.*")


def rows(cells_: DataFrame) -> DataFrame:
    """One row for each table row, its cells in ``cells``, in order."""
    packed = F.array_sort(F.collect_list(F.struct("n", "header", "text", "classes", "href", "label")))
    return cells_.groupBy("doc", "page_id", "tab", "tab_id", "tab_class", "row").agg(packed.alias("cells"))


def _filled(value: Column, *by: str) -> Column:
    """The last value that is there, in this page (and ``by``) up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("doc", *by).orderBy("place"))


def news(pages: DataFrame, html: str = "html", id: str = "page_id", table_id: str = "news-table") -> DataFrame:
    """``page_id``, ``row``, ``headline``, ``url`` and ``published_at`` of a news table.  Its first cell holds a date and a time, or
    a time alone, and then the date above counts."""
    r = table_rows(pages, html, id).where(F.col("tab_id") == table_id).withColumn("cells", F.filter("cells", lambda c: ~c["header"])).where(F.size("cells") >= 2)
    stamp, link = F.col("cells")[0]["text"], F.col("cells")[1]
    words = F.split(stamp, r"\s+")
    r = r.withColumn("day", _filled(F.when(stamp.rlike("^[A-Za-z]"), words[0]), "tab"))
    at = F.try_to_timestamp(F.concat_ws(" ", "day", F.element_at(words, -1)), F.lit("MMM-dd-yy hh:mma"))
    return r.where(F.coalesce(link["label"], F.lit("")) != "").select("page_id", "row", link["label"].alias("headline"), link["href"].alias("url"), F.when(stamp != "", at).alias("published_at"))


#: Layouts of a calendar's date headers (after the week day), of its times, and names that head columns.
HEADER_DATES = ("MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "yyyy-MM-dd")
TIMES = ("h:mm a", "h:mma", "H:mm")
COLUMN_NAMES = ("event", "release", "indicator", "name")


def header_date(text: Column, as_of: Column) -> Column:
    """The day of a date header; without a year, the one within 180 days of ``as_of``."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), r"^[A-Za-z]+day, ", "")
    short = F.regexp_replace(plain, r"\.", "")
    return F.coalesce(*[F.try_to_date(short if "MMM d" in x else plain, x) for x in HEADER_DATES], S.infer_year(text, as_of))


def event_time(day: Column, text: Column) -> Column:
    """UTC time of a day and a New York clock time; midnight where there is none."""
    clock = F.trim(F.replace(F.upper(F.trim(text)), F.lit("ET"), F.lit("")))
    local = F.coalesce(*[F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), clock), F.lit(f"yyyy-MM-dd {x}")) for x in TIMES])
    return F.coalesce(F.to_utc_timestamp(local, "America/New_York"), day.cast("timestamp"))


def calendar(pages: DataFrame, as_of: str, html: str = "html", id: str = "page_id") -> DataFrame:
    """Events of each page's calendar table (the first whose class says so, else its first table): ``page_id``, ``row``,
    ``event_date``, ``event_at``, ``time_text``, ``name``, ``period``, ``actual``, ``consensus``, ``prior``, ``category``, ``importance``.  A row
    of one cell, or with a cell of class date or day, heads the rows below it; rows have six, five, four or three
    cells."""
    r = table_rows(pages, html, id)
    named = F.col("tab_class").rlike("calendar|economic")
    chosen = F.coalesce(F.min(F.when(named, F.col("tab"))).over(Window.partitionBy("doc")), F.min("tab").over(Window.partitionBy("doc")))
    r = r.withColumn("chosen", chosen).where("tab = chosen").withColumn("k", F.size("cells"))
    whole = F.array_join(F.transform("cells", lambda c: c["text"]), "")
    may_head = (F.col("k") == 1) | F.exists("cells", lambda c: c["classes"].rlike("date|day"))
    r = r.withColumn("heads", F.when(may_head, header_date(whole, F.lit(as_of).cast("date"))))
    r = r.withColumn("event_date", _filled(F.col("heads"))).where("heads IS NULL AND k >= 3 AND event_date IS NOT NULL")
    at = lambda i: F.col("cells")[i]["text"]
    k, none = F.col("k"), F.lit("")
    pick = lambda six, five, four, three: F.when(k >= 6, six).when(k == 5, five).when(k == 4, four).otherwise(three)
    r = r.withColumns({
        "time_text": pick(at(0), at(0), at(0), none), "name": pick(at(1), at(1), at(1), at(0)), "period": pick(at(2), at(2), none, none),
        "actual": pick(at(3), none, none, none), "consensus": pick(at(4), at(3), at(2), at(2)), "prior": pick(at(5), at(4), at(3), none),
    }).where((F.length("name") >= 3) & ~F.lower("name").isin(*COLUMN_NAMES))
    return r.select("page_id", "row", "event_date", event_time(F.col("event_date"), F.col("time_text")).alias("event_at"), "time_text", "name", "period", "actual", "consensus", "prior", S.macro_category(F.col("name")).alias("category"), S.macro_importance(F.col("name")).alias("importance"))


def label_values(pages: DataFrame, html: str = "html", id: str = "page_id", table_class: str = "snapshot") -> DataFrame:
    """``page_id``, ``label`` and ``value`` of tables whose rows alternate between labels and values; ``-`` is no value."""
    c = cells(pages, html, id).where(F.col("tab_class").contains(table_class))
    value = F.lead("text").over(Window.partitionBy("doc", "row").orderBy("n"))
    return c.withColumn("value", value).where("n % 2 = 1 AND value IS NOT NULL AND value <> '-' AND text <> ''").select("page_id", F.col("text").alias("label"), "value")


_RSS = "channel STRUCT<item ARRAY<STRUCT<title STRING, link STRING, description STRING, pubDate STRING, category STRING>>>"
_ATOM = "entry ARRAY<STRUCT<title STRING, link STRUCT<_href STRING>, summary STRING, updated STRING>>"


def feeds(docs: DataFrame, xml: str = "xml", id: str = "feed_id") -> DataFrame:
    """``feed_id``, ``n`` (from 0), ``headline``, ``snippet`` (tags out, 400 characters at most), ``url``, ``published_at`` and ``category`` of RSS
    2.0 and Atom feeds; an Atom entry's time is when it was updated.  Entries without a title, and feeds that are not
    XML, give no rows."""
    plain = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), "<[^>]+>", " ")
    d = docs.select(F.col(id).alias("feed_id"), F.col(xml).alias("xml"), F.lower(F.regexp_extract(xml, r"(?s)<([A-Za-z][\w:.-]*)", 1)).contains("feed").alias("atom"))
    rss = d.where("NOT atom").select("feed_id", F.posexplode(F.from_xml("xml", _RSS)["channel"]["item"]).alias("n", "i")).select(
        "feed_id", "n", S.strip(F.col("i.title")).alias("headline"), F.substring(F.regexp_replace(S.strip(plain(F.col("i.description"))), r"\s+", " "), 1, 400).alias("snippet"),
        F.coalesce(S.strip(F.col("i.link")), F.lit("")).alias("url"), F.col("i.pubDate").alias("at"), F.coalesce("i.category", F.lit("")).alias("category"))
    atom = d.where("atom").select("feed_id", F.posexplode(F.from_xml("xml", _ATOM)["entry"]).alias("n", "i")).select(
        "feed_id", "n", S.strip(F.col("i.title")).alias("headline"), F.substring(S.strip(plain(F.col("i.summary"))), 1, 400).alias("snippet"),
        F.coalesce("i.link._href", F.lit("")).alias("url"), F.col("i.updated").alias("at"), F.lit("").alias("category"))
    both = rss.unionByName(atom).where("headline <> ''")
    return both.withColumn("published_at", S.parse_time(F.col("at"))).drop("at")


def unique_articles(articles: DataFrame) -> DataFrame:
    """The first article of each address (of each headline where there is no address), by feed and place."""
    key = F.when(F.col("url") != "", F.col("url")).otherwise(F.col("headline"))
    first = articles.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*articles.columns), F.struct("feed_id", "n")).alias("a"))
    return first.select("a.*")
