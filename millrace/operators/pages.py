"""Data that pages and feeds carry beside their text: JSON-LD, OpenGraph, tables, embedded state, resolved anchors, feed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import records as C
from millrace.functions import urls as U

_SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script>"
#: Double-quoted strings with their escapes, and the stretches between them.
_STRINGS = r'"(?:[^"\\]++|\\[\s\S])*+"?|[^"]+'
_LATER = "kit.start("


def unescaped(text: Column) -> Column:
    """Text with the five named references of XML and those of quotes by number decoded, ampersands last."""
    for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(sign))
    return text


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not, decoded; null without it."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    return F.when(tag.rlike(pattern), unescaped(value))


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"<!--[\s\S]*?(?:-->|\z)", "")


def scripts(html: Column) -> Column:
    """array<struct<attrs, body>> of the scripts that are closed; bodies trimmed."""
    whole = F.regexp_extract_all(html, F.lit(_SCRIPT), 0)
    return F.transform(whole, lambda s: F.struct(F.regexp_extract(s, _SCRIPT, 1).alias("attrs"), C.trimmed(F.regexp_extract(s, _SCRIPT, 2)).alias("body")))


def _items(value: Column) -> Column:
    """array<variant>: the items of an array, else the value alone; none of null."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<variant>"))


def sane_json(text: Column) -> Column:
    """JSON text with line breaks and tabs within its strings escaped."""
    inner = lambda t: F.replace(F.replace(F.replace(t, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_STRINGS), 0), lambda t: F.when(t.startswith('"'), inner(t)).otherwise(t)), "")


def linked_data(html: Column, most_bytes: int = 512 << 10) -> Column:
    """array<variant> of a page's JSON-LD blocks, items of arrays apart; a block that is no JSON is tried again with sane strings.
    Larger blocks than most_bytes are not read, as in the reference."""
    kept = F.filter(scripts(html), lambda s: F.lower(s["attrs"]).contains("application/ld+json") & (s["body"] != "") & (F.octet_length(s["body"]) <= most_bytes))
    read = F.transform(kept, lambda s: F.coalesce(F.try_parse_json(s["body"]), F.try_parse_json(sane_json(s["body"]))))
    return F.flatten(F.transform(F.filter(read, lambda v: v.isNotNull()), _items))


def next_data(html: Column) -> Column:
    """array<variant>: the page's properties of the __NEXT_DATA__ script, or the whole object without any; at most one."""
    found = F.filter(scripts(html), lambda s: s["attrs"].rlike(r"""(?i)[\s/]id\s*=\s*["']?__NEXT_DATA__(?![^\s"'/])""") & (F.octet_length(s["body"]) >= 20))
    data = F.try_parse_json(F.try_element_at(found, F.lit(1))["body"])
    props = F.try_variant_get(data, "$.props.pageProps", "variant")
    full = F.schema_of_variant(props).startswith("OBJECT") & (F.to_json(props) != "{}")
    return F.when(full, F.array(props)).when(F.schema_of_variant(data).startswith("OBJECT"), F.array(data)).otherwise(F.array().cast("array<variant>"))


def sveltekit(html: Column) -> Column:
    """array<variant> of the `data: [...]` of kit.start(): keys get quotes, wrappers {data: ...} are taken off."""
    region = F.when(html.contains(_LATER), F.regexp_replace(html, r"^[\s\S]*?kit\.start\(", ""))
    tail = F.when(region.contains("data: ["), F.regexp_replace(region, r"^[\s\S]*?data: (?=\[)", ""))
    tokens = F.regexp_extract_all(tail, F.lit(r'"(?:[^"\\]++|\\[\s\S])*+"?|[\[\]]|[^"\[\]]+'), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t == "[", 1).when(t == "]", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), F.when((s["end"] == 0) & (depth == 0), s["at"] + 1).otherwise(s["end"]).alias("end"))

    end = F.aggregate(tokens, start, step, lambda s: s["end"])
    quoted = F.transform(F.slice(tokens, F.lit(1), end), lambda t: F.when(t.startswith('"'), t).otherwise(F.regexp_replace(t, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)(?=\s*:)", '$1"$2"')))
    raw = F.array_join(F.slice(tokens, F.lit(1), end), "")
    items = F.when((end > 0) & (F.octet_length(raw) >= 50), F.try_variant_get(F.try_parse_json(F.array_join(quoted, "")), "$", "array<variant>"))
    holds = lambda v: F.coalesce(F.schema_of_variant(v).rlike("^(?:OBJECT|ARRAY)"), F.lit(False))
    inner = F.transform(items, lambda v: F.when(holds(F.try_variant_get(v, "$.data", "variant")), F.try_variant_get(v, "$.data", "variant")).when(holds(v), v))
    return F.coalesce(F.filter(inner, lambda v: v.isNotNull()), F.array().cast("array<variant>"))


def schema_type(value: Column) -> Column:
    """`@type` of an object: a string, or the first string of an array."""
    raw = F.try_variant_get(value, "$['@type']", "variant")
    first = F.filter(F.try_variant_get(raw, "$", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string")).otherwise(F.try_variant_get(F.try_element_at(first, F.lit(1)), "$", "string"))


def schema_id(value: Column) -> Column:
    raw = F.try_variant_get(value, "$['@id']", "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string"))


def structured_pass(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id, n_json_ld, n_next_data, n_sveltekit, kind, value, schema_type, schema_id): how many values each source gave, and the first of the richest:
    JSON-LD before Next data before SvelteKit; value is its JSON text with sorted keys. A page without any has null in these."""
    each = pages.select(id_col, linked_data(F.col(html_col)).alias("a"), next_data(F.col(html_col)).alias("b"), sveltekit(F.col(html_col)).alias("c"))
    first = F.coalesce(*[F.try_element_at(x, F.lit(1)) for x in ("a", "b", "c")])
    kind = F.when(F.size("a") > 0, "jsonld").when(F.size("b") > 0, "next_data").when(F.size("c") > 0, "sveltekit")
    sizes = [F.greatest(F.size(x), F.lit(0)).alias(n) for x, n in (("a", "n_json_ld"), ("b", "n_next_data"), ("c", "n_sveltekit"))]
    return each.select(id_col, *sizes, kind.alias("kind"), F.to_json(first).alias("value"), schema_type(first).alias("schema_type"), schema_id(first).alias("schema_id"))


def _with_source(json: Column, url: Column, parser: str) -> Column:
    """An object's JSON text with _parser and _source_url, unless it has them, keys sorted."""
    v = F.parse_json(json)
    extra = [F.when(F.try_variant_get(v, f"$.{n}", "variant").isNull(), F.concat(F.lit(f'"{n}":'), F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]\z", ""))) for n, x in (("_parser", F.lit(parser)), ("_source_url", url))]
    inner = F.regexp_replace(json, r"^\{|\}\z", "")
    whole = F.to_json(F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *extra, F.when(inner != "", inner)), F.lit("}"))))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), whole).otherwise(json)


def _flat_results(v: Column) -> Column:
    """array<variant>: what `results` holds if that is an array, else the items of an array, an object alone, nothing of others."""
    results = F.try_variant_get(v, "$.results", "variant")
    kind, none = F.schema_of_variant(v), F.array().cast("array<variant>")
    items = F.when(F.schema_of_variant(results).startswith("ARRAY"), F.try_variant_get(results, "$", "array<variant>"))
    return F.coalesce(items, F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.when(kind.startswith("OBJECT"), F.array(v)), none)


def page_items(pages: DataFrame, id_col: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, at, parser, item) of what JSON-LD blocks, OpenGraph tags and tables of a page say, in this order, as JSON text with sorted keys.

    Items carry their parser and the page's address; equal ones count once, at their first place. JSON-LD gives the items of `results` or of an
    array, or an object; OpenGraph one object of its og: properties, the last value of each; a table that is not in another the number
    of its rows. All of it happens in the row of the page."""
    html, url = without_comments(F.col(html_col)), F.col(url_col)
    blocks = F.filter(scripts(html), lambda s: F.lower(attribute(F.concat(F.lit(" "), s["attrs"]), "type")).contains("application/ld+json"))
    values = F.flatten(F.transform(blocks, lambda s: _flat_results(F.try_parse_json(s["body"]))))
    ld = F.transform(F.transform(values, lambda v: F.to_json(v)), lambda j: _with_source(j, url, "json-ld"))

    metas = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), 0)
    said = F.transform(metas, lambda m: F.struct(F.coalesce(attribute(m, "property"), attribute(m, "name")).alias("key"), attribute(m, "content").alias("value")))
    og = F.filter(said, lambda p: F.lower(p["key"]).startswith("og:") & (F.coalesce(p["value"], F.lit("")) != ""))
    last = F.filter(og, lambda p, i: ~F.exists(F.slice(og, i + 2, F.size(og)), lambda q: q["key"] == p["key"]))
    graph = F.when(F.size(og) > 0, F.array(_with_source(F.to_json(F.map_from_entries(last)), url, "open-graph"))).otherwise(F.array().cast("array<string>"))

    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(/?(?:table|tr))(?=[\s/>])"), 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("rows"), F.array().cast("array<int>").alias("done"))

    def step(s: Column, t: Column) -> Column:
        low = F.lower(t)
        opens, closes = low == "table", (low == "/table") & (s["depth"] > 0)
        ends = closes & (s["depth"] == 1) & (s["rows"] > 0)
        return F.struct(
            (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(opens & (s["depth"] == 0), 0).otherwise(s["rows"] + F.when((low == "tr") & (s["depth"] > 0), 1).otherwise(0)).alias("rows"),
            F.when(ends, F.concat(s["done"], F.array(s["rows"]))).otherwise(s["done"]).alias("done"),
        )

    rows = F.aggregate(tags, start, step, lambda s: s["done"])
    tables = F.transform(rows, lambda n: _with_source(F.concat(F.lit('{"rows":'), n, F.lit("}")), url, "html-table"))
    found = pages.select(id_col, F.posexplode(F.array_distinct(F.flatten(F.array(ld, graph, tables)))).alias("at", "item"))
    return found.select(id_col, "at", F.get_json_object("item", "$._parser").alias("parser"), "item")


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute address, relative to the address of its page; dots in paths are followed. Null without an absolute base."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    own, rest = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"^[^?#]*([\s\S]*)", 1)
    merged = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(path, r"[^/]*\z", ""), own))
    parts = F.split(F.regexp_replace(merged, "^/?", ""), "/", -1)
    n = F.size(parts)
    kept = F.aggregate(
        F.transform(parts, lambda p, i: F.struct(p.alias("p"), (i == n - 1).alias("last"))),
        F.array().cast("array<string>"),
        lambda out, x: F.when(x["p"] == "..", F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.when(x["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))))
        .when(x["p"] == ".", F.when(x["last"], F.concat(out, F.array(F.lit("")))).otherwise(out))
        .otherwise(F.concat(out, F.array(x["p"]))),
    )
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    home = F.when(path == "", "/").otherwise(path)
    rooted = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)(?=[?#]|\z)"  # an address without a path has the root
    given = F.when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
    return F.when(
        origin != "",
        F.when(given.isNotNull(), F.regexp_replace(given, rooted, "$1/"))
        .when(own == "", F.concat(origin, home, F.when(rest.startswith("?"), rest).otherwise(F.concat(query, rest))))
        .otherwise(F.concat(origin, F.lit("/"), F.array_join(kept, "/"), rest)),
    )


def anchors(base: Column, html: Column, limit: int | None = None) -> Column:
    """Absolute http addresses of the quoted hrefs of a page's anchors, relative ones resolved, in order, once each, at most limit."""
    tags = F.regexp_extract_all(html, F.lit(r"<a(?=[ \t\n\r>])([^>]*)>"), 1)
    found = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(t, F.lit(r"""\shref=("[^"]*"|'[^']*')"""), 1)))
    bare = F.transform(found, lambda x: C.trimmed(F.regexp_replace(x, r"""^["']|["']\z""", "")))
    kept = F.filter(bare, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("javascript:") & ~x.startswith("mailto:"))
    out = F.array_distinct(F.filter(F.transform(kept, lambda x: resolved(base, x)), lambda x: x.rlike("^https?://")))
    return out if limit is None else F.slice(out, 1, limit)


_RSS = "channel struct<link:array<string>,item:array<struct<guid:string,title:string,link:array<string>,description:string,encoded:string,pubDate:string,author:string,creator:string>>>"
_LINK = "array<struct<_href:string,_rel:string>>"
_ATOM = f"link {_LINK}, entry array<struct<id:string,title:string,link:{_LINK},content:string,summary:string,published:string,updated:string,author:array<struct<name:string>>>>"
_JSON = "home_page_url string, items array<struct<id:string,url:string,external_url:string,title:string,content_html:string,content_text:string,summary:string,date_published:string,date_modified:string,authors:array<struct<name:string>>,author:struct<name:string>>>"


def _time(text: Column) -> Column:
    """A time as feeds write it, with a zone; null if it is none."""
    day = F.regexp_replace(C.trimmed(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(F.regexp_replace(day, r"\s*(?:GMT|UTC|UT|Z)\z", " +0000"), r"(\d{2}):(\d{2})\z", "$1$2")
    iso = F.try_to_timestamp(F.when(text.rlike(r"^\s*\d{4}-"), C.trimmed(text)))
    return F.coalesce(iso, F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")))


def feed_entries(feeds: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, at, format, entry_id, link, title, body_html, published, author, fault) of the entries of RSS, Atom and JSON feeds.

    The link is the alternate one, else the first, else an id that is an address; relative ones are resolved against the feed's own link.
    Entries without one are left out; of those whose links are the same but for fragments and tracking parameters the first stays. A text that
    is none of these feeds, or is broken, gives one row whose fault says so."""
    text = F.regexp_replace(F.col(text_col), r"^[﻿\s]+", "")
    bare = F.regexp_replace(F.regexp_replace(text, r"<(/?)(?:content):encoded\b", "<$1encoded"), r"<(/?)dc:creator\b", "<$1creator")
    kind = F.when(text.startswith("{"), "json").when(text.rlike(r"^(?:<\?xml[^>]*>|<!--[\s\S]*?-->|\s)*<(?:rss|rdf:RDF)\b"), "rss").when(text.rlike(r"^(?:<\?xml[^>]*>|<!--[\s\S]*?-->|\s)*<feed\b"), "atom")
    whole = F.when(kind == "rss", bare.rlike(r"</(?:rss|rdf:RDF)>\s*\z")).when(kind == "atom", bare.rlike(r"</feed>\s*\z")).otherwise(F.try_parse_json(text).isNotNull())
    read = feeds.select(id_col, F.when(whole, kind).alias("format"), bare.alias("t"))
    read = read.select(
        id_col,
        "format",
        F.from_xml(F.when(F.col("format") == "rss", F.col("t")), _RSS, {"mode": "PERMISSIVE"}).alias("rss"),
        F.from_xml(F.when(F.col("format") == "atom", F.col("t")), _ATOM, {"mode": "PERMISSIVE"}).alias("atom"),
        F.from_json(F.when(F.col("format") == "json", F.col("t")), _JSON).alias("json"),
    )
    first = lambda a: F.try_element_at(a, F.lit(1))
    full = lambda c: F.when(C.trimmed(c) != "", C.trimmed(c))
    http = lambda c: F.when(c.rlike("^https?://"), c)

    def entry(i, link, title, body, published, author) -> Column:
        return F.struct(i.alias("entry_id"), link.alias("link"), full(title).alias("title"), F.coalesce(body, F.lit("")).alias("body_html"), published.alias("published"), full(author).alias("author"))

    alternate = lambda links: F.coalesce(first(F.filter(links, lambda x: x["_rel"] == "alternate")), first(links))["_href"]
    from_rss = F.transform("rss.channel.item", lambda e: entry(e["guid"], F.coalesce(full(first(e["link"])), http(full(e["guid"]))), e["title"], F.coalesce(e["encoded"], e["description"]), _time(e["pubDate"]), F.coalesce(e["creator"], e["author"])))
    from_atom = F.transform("atom.entry", lambda e: entry(e["id"], F.coalesce(full(alternate(e["link"])), http(full(e["id"]))), e["title"], F.coalesce(e["content"], e["summary"]), F.coalesce(_time(e["published"]), _time(e["updated"])), first(e["author"])["name"]))
    from_json = F.transform("json.items", lambda e: entry(e["id"], F.coalesce(full(e["url"]), full(e["external_url"]), http(full(e["id"]))), e["title"], F.coalesce(e["content_html"], e["content_text"], e["summary"]), F.coalesce(_time(e["date_published"]), _time(e["date_modified"])), F.coalesce(first(e["authors"])["name"], e["author"]["name"])))
    home = F.when(F.col("format") == "rss", full(first("rss.channel.link"))).when(F.col("format") == "atom", alternate(F.col("atom.link"))).otherwise(F.col("json.home_page_url"))
    entries = F.when(F.col("format") == "rss", from_rss).when(F.col("format") == "atom", from_atom).otherwise(from_json)
    listed = read.select(id_col, "format", home.alias("home"), F.filter(entries, lambda e: e["link"].isNotNull()).alias("entries"))
    linked = listed.withColumn("entries", F.transform("entries", lambda e: e.withField("link", F.coalesce(resolved(F.col("home"), e["link"]), e["link"]))))
    named = linked.withColumn("names", F.transform("entries", lambda e: C.link_identity(e["link"])))
    kept = named.withColumn("entries", F.filter("entries", lambda e, i: F.array_position("names", F.element_at("names", i + 1)) == i + 1))
    broken = F.col("format").isNull()
    out = kept.select(id_col, "format", F.posexplode_outer(F.when(broken, F.array(F.lit(None).cast(kept.schema["entries"].dataType.elementType))).otherwise(F.col("entries"))).alias("at", "e"))
    return out.where("e IS NOT NULL OR format IS NULL").select(id_col, "at", "format", "e.*", F.when(F.col("format").isNull(), "no feed").alias("fault"))


#: How addresses of endpoints look within scripts: paths and words in quotes, sockets and whole addresses; attributes that link.
_PATHS = r"[A-Za-z0-9_./~:%+\-?=&]"
_WHOLE = rf"://[A-Za-z0-9.\-]{{1,253}}(?::[0-9]{{1,5}})?(?:/{_PATHS}{{0,500}})?"
ENDPOINT_SHAPES = [
    ("relative", rf"""["'`](/{_PATHS}{{0,240}}(?:api|graphql|gql|rest|gateway|internal|rpc|json|/v[0-9](?:/|\z)|v[0-9](?:/|\z)){_PATHS}{{0,240}})["'`]"""),
    ("word", r"""(?i)["'`]([^"'`]{0,160}(?:graphql|/gql)(?:/[^"'`]*)?)["'`]"""),
    ("socket", f"(wss?{_WHOLE})"),
    ("absolute", f"(https?{_WHOLE})"),
    ("attribute", r"""(?is)\b(?:href|src|action)\s*=\s*["']([^"']+)["']"""),
]


#: Endings of hosts below which a domain is registered.
MULTI_ENDINGS = ["co.uk", "co.jp", "co.nz", "co.za", "co.in", "co.kr", "com.au", "com.br", "com.mx", "com.ar", "com.sg", "com.hk", "net.au", "net.br", "org.uk", "org.au", "me.uk", "ac.uk", "gov.uk", "edu.au", "gov.au"]


def registrable(host: Column) -> Column:
    """The last two labels of a host, the last three below the endings above; a shorter host as it is."""
    n = F.when(host.rlike(rf"\.(?:{'|'.join(e.replace('.', chr(92) + '.') for e in MULTI_ENDINGS)})\z"), 3).otherwise(2)
    labels = F.split(host, r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def endpoints(pages: DataFrame, id_col: str, url_col: str = "url", html_col: str = "html", limit: int | None = None) -> DataFrame:
    """(id, at, value, normalized_url, kind, source, first_party) of the endpoints that a page names, in its scripts or attributes.

    Shapes are looked for one after the other; what looks like an endpoint and is none, and addresses without a real host, are left out. Of those with
    the same absolute address the first stays; at most limit, where one is given. first_party: registered under the same domain as the page."""
    html, base, found = F.col(html_col), F.col(url_col), []
    for shape, pattern in ENDPOINT_SHAPES:
        values = F.transform(F.regexp_extract_all(html, F.lit(pattern), 1), lambda v: F.regexp_replace(C.trimmed(v), r"""^["'`)(,;]+|["'`)(,;]+\z|\\+\z""", ""))
        if shape == "word":
            values = F.filter(values, lambda v: v.startswith("/") | F.lower(v).rlike("^(?:https?|wss?)://"))
        elif shape == "attribute":
            values = F.filter(values, U.is_endpoint)
        found.append(_named(values, "html_attribute" if shape == "attribute" else "inline_script"))
    good = F.filter(F.flatten(F.array(*found)), lambda e: (e["value"] != "") & ~U.endpoint_noise(e["value"]) & ((e["kind"] == "relative_path") | U.valid_host(e["value"])))
    placed = pages.select(id_col, base.alias("_base"), F.transform(good, lambda e: e.withField("normalized_url", F.when(e["kind"] == "websocket", e["value"]).otherwise(resolved(base, e["value"])))).alias("_e"))
    placed = placed.withColumn("_names", F.transform("_e", lambda e: F.coalesce(e["normalized_url"], e["value"])))
    once = F.filter("_e", lambda e, i: F.array_position("_names", F.element_at("_names", i + 1)) == i + 1)
    each = placed.select(id_col, "_base", F.posexplode(once if limit is None else F.slice(once, 1, limit)).alias("at", "e"))
    host, home = U.host(F.coalesce(F.col("e.normalized_url"), F.col("e.value"))), U.host(F.col("_base"))
    own = (host == "") | (host == home) | (registrable(host) == registrable(home))
    return each.select(id_col, "at", "e.value", "e.normalized_url", "e.kind", "e.source", F.coalesce(own, F.lit(True)).alias("first_party"))


def _named(values: Column, source: str) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("value"), C.endpoint_kind(v).alias("kind"), F.lit(source).alias("source")))
