"""Dependencies, toolchains, features and scripts that package manifests declare, five ecosystems in one shape of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import records as C

COLUMNS = ["line", "parser", "ecosystem", "scope", "fact", "name", "version", "quote", "fault"]
#: Sections of a Cargo manifest that are read, scopes of package.json, tags that pin a Java version, the best first.
CARGO_SCOPES = ["dependencies", "dev-dependencies", "build-dependencies", "workspace", "features", "package"]
NPM_SCOPES = ["dependencies", "devDependencies", "peerDependencies"]
JAVA_TAGS = ["maven.compiler.release", "maven.compiler.source", "java.version"]


def quoted(text: Column) -> Column:
    """What stands in single or double quotes, from the left; a quote that nothing closes ends the search."""
    found = F.regexp_extract_all(text, F.lit(r""""[^"]*"|'[^']*'|["'][\s\S]*"""), 0)
    closed = F.filter(found, lambda q: (F.length(q) > 1) & (F.substring(q, 1, 1) == F.right(q, F.lit(1))))
    return F.transform(closed, lambda q: F.substring(q, 2, 1 << 30).substr(F.lit(1), F.length(q) - 2))


def _fact(parser: str, ecosystem: str, scope, fact, name: Column, version: Column, quote: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(parser).alias("parser"), F.lit(ecosystem).alias("ecosystem"), lit(scope).alias("scope"), lit(fact).alias("fact"), name.alias("name"), version.cast("string").alias("version"), quote.alias("quote"))


def _lines(files: DataFrame, id_col: str, text_col: str, suffix: str, path_col: str) -> tuple[DataFrame, Window]:
    """(id, line, l, key, rest) of each line of the files of a name, trimmed; key and rest stand around the first equals sign."""
    each = files.where(F.col(path_col).endswith(suffix)).select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("at", "l"))
    each = each.select(id_col, (F.col("at") + 1).cast("long").alias("line"), C.trimmed(F.col("l")).alias("l"))
    cut = each.select("*", F.when(F.col("l").contains("="), C.trimmed(F.regexp_extract("l", "^([^=]*)=", 1))).alias("key"), F.regexp_extract("l", r"^[^=]*=([\s\S]*)", 1).alias("rest"))
    return cut, Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)


def _rows(each: DataFrame, id_col: str, facts: Column) -> DataFrame:
    return each.select(id_col, "line", F.explode(F.filter(facts, lambda f: f.isNotNull())).alias("f")).select(id_col, "line", "f.*", F.lit(None).cast("string").alias("fault"))


def _header(l: Column) -> Column:  # noqa: E741
    return F.when(l.startswith("[") & l.endswith("]"), l)


def _cargo(files: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    each, w = _lines(files, id_col, text_col, "Cargo.toml", path_col)
    line, key, rest = F.col("l"), F.col("key"), F.col("rest")
    each = each.withColumn("scope", F.regexp_replace(F.last(_header(line), ignorenulls=True).over(w), r"^\[|\]\z", ""))
    read = each.where(F.col("scope").isin(CARGO_SCOPES) & _header(line).isNull() & key.isNotNull() & (key != "") & ~key.startswith("#"))
    version = F.try_element_at(quoted(rest), F.lit(1))
    make = lambda scope, fact, name, v: _fact("cargo_manifest", "cargo", scope, fact, name, v, line)
    members = F.transform(quoted(rest), lambda q: make("workspace.members", "workspace_member", q, F.lit(None)))
    one = (
        F.when(F.col("scope") == "features", make("features", "manifest_feature", key, F.lit(None)))
        .when(F.col("scope").endswith("dependencies"), make(F.col("scope"), "dependency", key, version))
        .when((F.col("scope") == "package") & (key == "edition") & version.isNotNull(), make("package", "toolchain", F.lit("rust"), version))
        .when((F.col("scope") == "package") & (key == "rust-version") & version.isNotNull(), make("package", "toolchain_version", F.lit("rust"), version))
    )
    return _rows(read, id_col, F.when((F.col("scope") == "workspace") & (key == "members"), members).otherwise(F.array(one)))


def _go(files: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    each, _ = _lines(files, id_col, text_col, "go.mod", path_col)
    line, before = F.col("l"), Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(line.isin("require (", ")"), line)
    each = each.withColumn("inside", F.coalesce(F.last(mark, ignorenulls=True).over(before) == "require (", F.lit(False)))
    each = each.where((line != "require (") & ~(F.col("inside") & (line == ")")))
    tool = F.when(line.startswith("go "), C.trimmed(F.regexp_replace(line, "^go ", ""))).when(line.startswith("toolchain "), F.regexp_replace(C.trimmed(F.regexp_replace(line, "^toolchain ", "")), "^go", ""))
    bare = F.regexp_replace(line, "^require ", "")
    words = F.filter(F.split(bare, r"\s+"), lambda x: x != "")
    taken = (bare != "") & ~bare.startswith("//") & (F.col("inside") | (bare != line))
    dep = F.when(taken & (F.size(words) > 0), _fact("go_mod", "go", "require", "dependency", F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2)), line))
    pin = F.when(tool != "", _fact("go_mod", "go", "toolchain", "toolchain_version", F.lit("go"), tool, line))
    return _rows(each, id_col, F.array(F.when(~F.col("inside") & tool.isNotNull(), pin).otherwise(dep)))


def _npm(files: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    read = files.where(F.col(path_col).endswith("package.json") & F.col(text_col).isNotNull()).select(id_col, F.lit(1).cast("long").alias("line"), F.try_parse_json(F.col(text_col)).alias("v"))
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    held = lambda scope: F.map_entries(F.try_variant_get("v", f"$.{scope}", "map<string,variant>"))
    none = F.array().cast("array<struct<parser:string,ecosystem:string,scope:string,fact:string,name:string,version:string,quote:string>>")
    make = lambda scope, fact, e, v, q: _fact("package_json", "npm", scope, fact, e["key"], v, F.concat(e["key"], F.lit(": "), q))
    dependency = lambda scope: lambda e: make(scope, "dependency", e, text(e["value"]), F.coalesce(F.to_json(e["value"]), F.lit("null")))
    facts = [F.transform(held(s), dependency(s)) for s in NPM_SCOPES]
    facts.append(F.transform(held("scripts"), lambda e: make("scripts", "toolchain_script", e, F.when(text(e["value"]) != "", text(e["value"])), F.coalesce(text(e["value"]), F.lit("")))))
    engines = F.filter(held("engines"), lambda e: text(e["value"]).isNotNull())
    facts.append(F.transform(engines, lambda e: make("engines", "toolchain_version", e, text(e["value"]), text(e["value"]))))
    out = _rows(read.where("v IS NOT NULL"), id_col, F.flatten(F.array(*[F.coalesce(f, none) for f in facts])))
    broken = read.where("v IS NULL").select(id_col, *[F.lit("parse.manifest.invalid" if c == "fault" else None).cast("long" if c == "line" else "string").alias(c) for c in COLUMNS])
    return out.unionByName(broken)


def _tag(text: Column, tag: str) -> Column:
    """What stands in the first element of a name, trimmed; null if nothing does."""
    name = tag.replace(".", r"\.")
    value = C.trimmed(F.regexp_extract(text, rf"<{name}>([\s\S]*?)(?:</{name}>|<{name}>|\z)", 1))
    return F.when(value != "", value)


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _maven(files: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    read = files.where(F.col(path_col).endswith("pom.xml")).select(id_col, F.col(text_col).alias("t"))
    # each piece is a block with what stands before it since the last
    pieces = read.select(id_col, F.regexp_extract_all("t", F.lit(r"[\s\S]*?<dependency>[\s\S]*?</dependency>"), 0).alias("ps"))
    sizes = F.transform("ps", _breaks)
    each = pieces.select(id_col, sizes.alias("sizes"), F.posexplode("ps").alias("at", "p"))
    block = F.regexp_extract("p", r"<dependency>[\s\S]*", 0)
    above = F.aggregate(F.slice("sizes", F.lit(1), F.col("at")), F.lit(0), lambda s, x: s + x) + _breaks(F.regexp_extract("p", r"^[\s\S]*?(?=<dependency>)", 0))
    each = each.select(id_col, (above + 1).cast("long").alias("line"), block.alias("b"))
    name = F.concat(_tag(F.col("b"), "groupId"), F.lit(":"), _tag(F.col("b"), "artifactId"))
    compact = C.trimmed(F.regexp_replace("b", r"\s+", " "))
    deps = _rows(each, id_col, F.array(F.when(name.isNotNull(), _fact("maven_pom", "maven", "dependencies", "dependency", name, _tag(F.col("b"), "version"), compact))))
    found = F.coalesce(*[F.when(_tag(F.col("t"), g).isNotNull(), F.struct(F.lit(g).alias("tag"), _tag(F.col("t"), g).alias("value"))) for g in JAVA_TAGS])
    pinned = read.withColumn("x", found).where("x IS NOT NULL")
    opened = F.concat(F.lit("<"), F.col("x.tag"), F.lit(">"))
    head = F.split_part(F.col("t"), opened, F.lit(1))
    lead = F.regexp_extract(F.split_part(F.col("t"), opened, F.lit(2)), r"^[ \t\r\n]*", 0)
    quote = F.concat(opened, F.col("x.value"), F.lit("</"), F.col("x.tag"), F.lit(">"))
    tool = pinned.withColumn("line", (_breaks(head) + _breaks(lead) + 1).cast("long"))
    return deps.unionByName(_rows(tool, id_col, F.array(_fact("maven_pom", "maven", "properties", "toolchain_version", F.lit("java"), F.col("x.value"), quote))))


def _requirement(text: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(text, r"[=<>!~\[][\s\S]*", 0)
    return F.regexp_extract(text, r"^[^=<>!~\[]*", 0), F.when(rest != "", rest)


def _python(files: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    listed, _ = _lines(files, id_col, text_col, "requirements.txt", path_col)
    line = F.col("l")
    name, version = _requirement(line)
    plain = F.when((line != "") & ~line.startswith("#") & (C.trimmed(name) != ""), _fact("requirements_txt", "python", "runtime", "dependency", C.trimmed(name), version, line))
    each, w = _lines(files, id_col, text_col, "pyproject.toml", path_col)
    each = each.withColumn("section", F.last(_header(line), ignorenulls=True).over(w))
    key, rest = F.col("key"), F.col("rest")
    none = F.array().cast("array<struct<parser:string,ecosystem:string,scope:string,fact:string,name:string,version:string,quote:string>>")
    make = lambda scope, fact, n, v, q: _fact("pyproject_toml", "python", scope, fact, n, v, q)
    deps = F.when(line.startswith("dependencies"), F.transform(quoted(line), lambda q: make("project.dependencies", "dependency", *_requirement(q), q))).otherwise(none)
    packages = F.array_join(quoted(rest), ", ")
    extra = (F.col("section") == "[project.optional-dependencies]") & _header(line).isNull() & (key != "")
    extras = F.when(extra, F.array(make("project.optional-dependencies", "manifest_extra", key, F.when(F.size(quoted(rest)) > 0, packages), line))).otherwise(none)
    tools = F.when(key == "requires-python", F.transform(quoted(rest), lambda q: make("project", "toolchain_version", F.lit("python"), q, line))).otherwise(none)
    return _rows(listed, id_col, F.array(plain)).unionByName(_rows(each, id_col, F.flatten(F.array(deps, extras, tools))))


def manifest_facts(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """(id, line, parser, ecosystem, scope, fact, name, version, quote, fault) of what Cargo.toml, package.json, requirements.txt, pyproject.toml,
    go.mod and pom.xml files declare, told by the end of their path.

    A package.json that is no JSON gives one row with a fault; null texts and files of other names give none. Files whose sections
    matter are dealt by id, the others are read where they are."""
    parts = [read(files, id_col, text_col, path_col) for read in (_cargo, _npm, _python, _go, _maven)]
    return reduce(DataFrame.unionByName, [p.select(id_col, *COLUMNS) for p in parts])
