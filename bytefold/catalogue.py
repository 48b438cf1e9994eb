"""Registered queries of the reference's operators over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import descriptors as D
from .functions import literals as L
from .functions import names as N
from .operators import cfg, naming
from .plans.loops import closure

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL pieces that several oracles share

def _hash_sql(x: str) -> str:
    folded = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296)"
    return f"CASE WHEN {x} = '' THEN 0 ELSE {folded} END"


def _signed(x: str) -> str:
    return f"(CASE WHEN {x} >= 2147483648 THEN {x} - 4294967296 ELSE {x} END)::INTEGER"


def _clean(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[\\p{{L}}_$][\\p{{L}}\\p{{N}}_$]*') THEN {x} ELSE regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_$]', '', 'g') END"


def _part(x: str, longest: int = 16) -> str:
    return f"CASE WHEN length({x}) > {longest} THEN 'x' || printf('%x', {_hash_sql(x)}) ELSE {_clean(x)} END"


# ---- names

@query(f"SELECT 'part' AS origin, p_partkey AS id, {_signed(_hash_sql('p_name'))} AS hash FROM part UNION ALL SELECT 'customer', c_custkey, {_signed(_hash_sql('c_name'))} FROM customer")
def java_hash_names(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.lit("part").alias("origin"), F.col("p_partkey").alias("id"), N.java_hash(F.col("p_name")).alias("hash"))
    return part.unionByName(table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), N.java_hash(F.col("c_name")).alias("hash")))


@query("""SELECT s_suppkey, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(s_name, ''), lambda c: ascii(c)::BIGINT)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)::BIGINT AS crc FROM supplier""")
def crc32_names(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.crc32(F.col("s_name").cast("binary")).alias("crc"))


_RESERVED = ", ".join(f"'{w}'" for w in N.RESERVED)


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT role FROM conversations UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part UNION SELECT unnest([{_RESERVED}]))
SELECT name, regexp_full_match(name, '[\\p{{L}}_$][\\p{{L}}\\p{{N}}_$]*') AS valid, name IN ({_RESERVED}) AS reserved FROM n""")
def identifier_check(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "conversations").select("role")).union(part.select(F.explode(F.split("p_name", " "))))
    names = names.union(spark.createDataFrame([(w,) for w in N.RESERVED], "name string")).distinct()
    return names.select("name", N.is_identifier(F.col("name")).alias("valid"), N.is_reserved(F.col("name")).alias("reserved"))


@query(f"SELECT c_custkey, {_clean('c_name')} AS cleaned FROM customer")
def identifier_clean(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.clean_identifier(F.col("c_name")).alias("cleaned"))


@query(f"SELECT c_custkey, {_part('c_name')} AS long_part, {_part('c_mktsegment')} AS short_part FROM customer")
def name_part(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.name_part(F.col("c_name")).alias("long_part"), N.name_part(F.col("c_mktsegment")).alias("short_part"))


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS number FROM part)
SELECT p_partkey, number::BIGINT AS number, printf('p%03d', number) || ({_part('p_name')}) AS package_alias, CASE p_type WHEN 'ECONOMY' THEN 'Enum' WHEN 'PROMO' THEN 'Interface' WHEN 'LARGE' THEN 'Abstract' ELSE '' END || printf('C%04d', number) || ({_part('p_name')}) AS class_alias,
printf('f%d', number) || ({_part('p_brand')}) AS field_alias FROM n""")
def alias_numbering(spark, sf_dir):
    n = naming.number_by_kind(table(spark, sf_dir, "part"), "p_type", ["p_partkey"])
    number, name = F.col("number").cast("int"), F.col("p_name")
    prefix = F.when(F.col("p_type") == "ECONOMY", "Enum").when(F.col("p_type") == "PROMO", "Interface").when(F.col("p_type") == "LARGE", "Abstract").otherwise("")
    return n.select("p_partkey", "number", N.package_alias(number, name).alias("package_alias"), N.class_alias(number, name, prefix).alias("class_alias"), N.field_alias(number, F.col("p_brand")).alias("field_alias"))


@query(f"""SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_name) > 1 THEN 'mo' ELSE 'm' END || (row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) || ({_part('p_name')}) AS alias FROM part""")
def alias_overload_prefix(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_name")))
    n = naming.number_by_kind(part, "p_type", ["p_partkey"])
    return n.select("p_partkey", N.method_alias(F.col("number").cast("int"), F.col("p_name"), F.col("same") > 1).alias("alias"))


@query("""WITH r AS (SELECT 'c' AS kind, o_custkey::VARCHAR AS node, 'order' || o_orderkey AS alias, o_orderkey AS ord, 1 AS part FROM orders UNION ALL SELECT 'c', s_suppkey::VARCHAR, s_name, s_suppkey, 0 FROM supplier)
SELECT kind, node, alias FROM r QUALIFY row_number() OVER (PARTITION BY kind, node ORDER BY part, ord, alias) = 1""")
def rename_first_wins(spark, sf_dir):
    """A loaded map, of suppliers, comes before the one at hand, of orders."""
    loaded = table(spark, sf_dir, "supplier").select(F.lit("c").alias("kind"), F.col("s_suppkey").cast("string").alias("node"), F.col("s_name").alias("alias"), F.col("s_suppkey").cast("long").alias("ord"))
    have = table(spark, sf_dir, "orders").select(F.lit("c").alias("kind"), F.col("o_custkey").cast("string").alias("node"), F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("alias"), F.col("o_orderkey").cast("long").alias("ord"))
    return naming.merge_renames(loaded, have).select("kind", "node", "alias")


@query("SELECT 'c' AS kind, n_name AS node, r_name || '_' || n_nationkey AS alias FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'c', r_name, r_name FROM region")
def rename_apply(spark, sf_dir):
    """Nations and regions are declared; nations have renames."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    renames = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.lit("c").alias("kind"), F.col("n_name").alias("node"), F.concat("r_name", F.lit("_"), F.col("n_nationkey").cast("string")).alias("alias"))
    declared = nation.select(F.col("n_name").alias("name")).unionByName(region.select(F.col("r_name").alias("name"))).select(F.lit("c").alias("kind"), F.col("name").alias("node"), "name")
    return naming.apply_renames(declared, renames).select("kind", "node", "alias")


_LINE_SQL = "'v ' || replace(p_name, ' ', '/') || CASE WHEN p_partkey % 3 = 0 THEN '#' || p_size ELSE '' END || ' = ' || replace(p_brand, '#', '')"


def _lines(spark, sf_dir):
    slot = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size"))
    line = N.rename_line(F.lit("v"), F.translate("p_name", " ", "/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), slot)
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


@query(f"SELECT {_LINE_SQL} AS line, count(*)::BIGINT AS times, min(p_partkey)::BIGINT AS first FROM part GROUP BY 1")
def rename_file_lines(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("line").agg(F.count(F.lit(1)).alias("times"), F.min("p_partkey").alias("first")).orderBy("line")


@query("SELECT p_partkey, 'v' AS kind, replace(p_name, ' ', '/') AS node, CASE WHEN p_partkey % 3 = 0 THEN p_size END::INTEGER AS slot, replace(p_brand, '#', '') AS alias FROM part")
def rename_file_parse(spark, sf_dir):
    return _lines(spark, sf_dir).select("p_partkey", N.parse_rename(F.col("line")).alias("r")).select("p_partkey", "r.*")


@query("SELECT p_partkey, 'c' AS kind, 'pkg/' || replace(p_name, ' ', '_') AS node, (p_size - 5)::INTEGER AS line, p_type || ' ' || p_brand AS text FROM part")
def comment_file_parse(spark, sf_dir):
    line = N.comment_line(F.lit("c"), F.concat(F.lit("pkg/"), F.translate("p_name", " ", "_")), F.col("p_size") - 5, F.concat_ws(" ", "p_type", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", N.parse_comment(line).alias("c")).select("p_partkey", "c.*")


@query("SELECT c.conv_id, coalesce(string_agg(text, '|' ORDER BY turn) FILTER (role <> 'system'), '') AS comments, count(*) FILTER (role <> 'system')::BIGINT AS n FROM conversations c GROUP BY c.conv_id")
def comment_attach(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    nodes = rows.select(F.lit("c").alias("kind"), F.col("conv_id").alias("node")).distinct()
    comments = rows.filter("role <> 'system'").select(F.lit("c").alias("kind"), F.col("conv_id").alias("node"), F.col("turn").alias("ord"), "text")
    out = naming.attach_comments(nodes, comments)
    return out.select(F.col("node").alias("conv_id"), F.coalesce(F.array_join("comments", "|"), F.lit("")).alias("comments"), F.coalesce(F.when(F.col("comments").isNotNull(), F.size("comments")), F.lit(0)).cast("long").alias("n"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
_PATTERNS = ["example.com", "site1.*", "www.*"]


@query(f"""SELECT page_id, host, host IN ('example.com') OR host = 'site1' OR starts_with(host, 'site1.') OR host = 'www' OR starts_with(host, 'www.') AS accepted FROM (SELECT page_id, {_HOST} AS host FROM pages)""")
def filter_patterns(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).withColumn("accepted", N.matches_any(F.col("host"), _PATTERNS))


@query("""SELECT doc_id, source IN ('src1', 'src2') OR starts_with(source, 'src1/') OR starts_with(source, 'src2/') AS listed, length(source) < 5 AS short, NOT (starts_with(source, '<') OR source IN ('this', 'super')) AS forced FROM documents""")
def whitelist_match(spark, sf_dir):
    source = F.col("source")
    return table(spark, sf_dir, "documents").select("doc_id", N.whitelisted(source, ["src1.*", "src2"]).alias("listed"), N.should_rename(source, 5, False).alias("short"), N.should_rename(source, 5, True).alias("forced"))


@query("""WITH u AS (SELECT page_id, regexp_extract(regexp_replace(url, '^[a-z]+://[^/]+', ''), '/([^/]*)$', 1) AS file FROM pages)
SELECT page_id, regexp_replace(file, '\\.[^.]*$', '') AS stem, CASE WHEN regexp_matches(file, '\\.(class)$') THEN 'class' WHEN regexp_matches(file, '\\.(dex|vdex)$') THEN 'dex' WHEN regexp_matches(file, '\\.(jar|zip|aar|aab|apk|xz|gradle)$') THEN 'archive' ELSE 'resource' END AS kind FROM u""")
def classify_extension(spark, sf_dir):
    from .sources.units import kind_of_path

    file = F.regexp_extract(F.regexp_replace("url", "^[a-z]+://[^/]+", ""), "/([^/]*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", file.alias("file")).select("page_id", F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), F.coalesce(kind_of_path(F.col("file")), F.lit("resource")).alias("kind"))


@query("""WITH b AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'CAFEBABE' WHEN 1 THEN '6465780A30333500' WHEN 2 THEN '504B0304' WHEN 3 THEN '6465780A30334100' ELSE '' END || hex(left(text, 4)) AS h FROM documents)
SELECT doc_id, CASE WHEN starts_with(h, 'CAFEBABE') THEN 'class' WHEN regexp_matches(h, '^6465780A3[0-9]3[0-9]3[0-9]00') THEN 'dex' WHEN starts_with(h, '504B0304') THEN 'archive' ELSE 'resource' END AS kind FROM b""")
def classify_magic(spark, sf_dir):
    from .sources.units import kind_of_bytes

    head = F.when(F.col("doc_id") % 5 == 0, "CAFEBABE").when(F.col("doc_id") % 5 == 1, "6465780A30333500").when(F.col("doc_id") % 5 == 2, "504B0304").when(F.col("doc_id") % 5 == 3, "6465780A30334100").otherwise("")
    data = F.concat(F.unhex(head), F.substring("text", 1, 4).cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", kind_of_bytes(data).alias("kind"))


_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""SELECT page_id, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS package, regexp_extract(p, '([^/]*)$', 1) AS simple, replace(replace(p, '/', '.'), '$', '.') AS dotted FROM (SELECT page_id, {_PATH} AS p FROM pages)""")
def package_split(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("p"))
    return p.select("page_id", N.package_of(F.col("p")).alias("package"), N.simple_name(F.col("p")).alias("simple"), N.source_name(F.col("p")).alias("dotted"))


@query(f"""SELECT package, count(*)::BIGINT AS classes, string_agg(simple, ',' ORDER BY page_id) AS members FROM (SELECT page_id, regexp_replace(p, '/[^/]*$', '') AS package, regexp_extract(p, '([^/]*)$', 1) AS simple FROM (SELECT page_id, {_PATH} AS p FROM pages)) GROUP BY package""")
def packages_group(spark, sf_dir):
    listed = package_split(spark, sf_dir).groupBy("package").agg(F.count(F.lit(1)).alias("classes"), F.sort_array(F.collect_list(F.struct("page_id", "simple"))).alias("m"))
    return listed.select("package", "classes", F.array_join("m.simple", ",").alias("members")).orderBy("package")


@query(f"""WITH p AS (SELECT DISTINCT replace(regexp_replace({_PATH}, '/[^/]*$', ''), '.', '_') AS package FROM pages)
SELECT DISTINCT split_part(package, '/', 1) AS parent, split_part(package, '/', 2) AS child FROM p WHERE contains(package, '/')""")
def subpackages_distinct(spark, sf_dir):
    return naming.subpackages(package_split(spark, sf_dir).select(F.translate("package", ".", "_").alias("package"))).select(F.col("parent"), F.col("child"))


@query("""WITH c AS (SELECT r_name AS name, r_regionkey AS ord FROM region UNION ALL SELECT r_name || '$' || n_name, 100 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0
  UNION ALL SELECT r_name || '$' || n_name || '$' || s_name, 1000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT DISTINCT name AS outer_name FROM c)
SELECT name, outer_name AS outer, outer_name IS NULL AS printed FROM c LEFT JOIN o ON contains(name, '$') AND outer_name = regexp_replace(name, '\\$[^$]*$', '')""")
def nesting_link(spark, sf_dir):
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    inner = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    names = region.select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("ord"))
    names = names.unionByName(inner.filter("n_nationkey % 4 <> 0").select(F.concat_ws("$", "r_name", "n_name").alias("name"), (F.col("n_nationkey") + 100).cast("long").alias("ord")))
    deep = supplier.join(inner, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.concat_ws("$", "r_name", "n_name", "s_name").alias("name"), (F.col("s_suppkey") + 1000).cast("long").alias("ord"))
    return naming.link_nested(names.unionByName(deep)).select("name", "outer", F.col("outer").isNull().alias("printed"))


# ---- descriptors, flags, literals

_DESC_SQL = "'(' || repeat('[', p_size % 3) || (['I', 'J', 'Ljava/lang/String;', 'D', 'Z'])[p_partkey % 5 + 1] || CASE WHEN p_partkey % 2 = 0 THEN 'J' ELSE '' END || ')' || (['V', 'I', '[B', 'Lpkg/A$B;'])[p_partkey % 4 + 1]"


def _descriptors(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("I", "J", "Ljava/lang/String;", "D", "Z")])
    backs = F.array(*[F.lit(x) for x in ("V", "I", "[B", "Lpkg/A$B;")])
    arg = F.concat(F.repeat(F.lit("["), F.col("p_size") % 3), kinds[(F.col("p_partkey") % 5).cast("int")], F.when(F.col("p_partkey") % 2 == 0, "J").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("("), arg, F.lit(")"), backs[(F.col("p_partkey") % 4).cast("int")]).alias("descriptor"))


@query(f"SELECT p_partkey, {_DESC_SQL} AS descriptor FROM part")
def descriptor_build(spark, sf_dir):
    return _descriptors(spark, sf_dir)


@query("""SELECT p_partkey, (['int', 'long', 'java.lang.String', 'double', 'boolean'])[p_partkey % 5 + 1] || repeat('[]', p_size % 3) || CASE WHEN p_partkey % 2 = 0 THEN ',long' ELSE '' END AS args,
(['void', 'int', 'byte[]', 'pkg.A.B'])[p_partkey % 4 + 1] AS ret, (p_size % 3)::INTEGER AS dims, (1 + CASE WHEN p_size % 3 = 0 AND p_partkey % 5 IN (1, 3) THEN 2 ELSE 1 END + CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END)::INTEGER AS slots FROM part""")
def descriptor_parse(spark, sf_dir):
    d = _descriptors(spark, sf_dir)
    args = D.arguments(F.col("descriptor"))
    return d.select("p_partkey", F.array_join(F.transform(args, D.readable), ",").alias("args"), D.readable(D.returned(F.col("descriptor"))).alias("ret"), D.dimensions(args[0]).alias("dims"), D.slots(F.col("descriptor"), F.lit(True)).alias("slots"))


_TYPES = "(['int', 'long', 'float', 'double', 'byte'])"


@query(f"""WITH t AS (SELECT DISTINCT p_size, {_TYPES}[p_size % 5 + 1] AS t FROM part), x AS (SELECT a.p_size AS a, b.p_size AS b, [a.t, b.t] AS l FROM t a JOIN t b ON a.p_size < b.p_size)
SELECT a, b, CASE WHEN list_contains(l, 'double') THEN 'double' WHEN list_contains(l, 'float') THEN 'float' WHEN list_contains(l, 'long') THEN 'long' ELSE 'int' END AS promoted FROM x""")
def type_promote(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("int", "long", "float", "double", "byte")])
    t = table(spark, sf_dir, "part").select("p_size").distinct().withColumn("t", kinds[F.col("p_size") % 5])
    return t.alias("x").join(F.broadcast(t.alias("y")), F.col("x.p_size") < F.col("y.p_size")).select(F.col("x.p_size").alias("a"), F.col("y.p_size").alias("b"), D.promote(F.col("x.t"), F.col("y.t")).alias("promoted"))


def _access_sql(kind: str) -> str:
    return " || ".join(f"CASE WHEN f & {bit} <> 0 THEN '{word} ' ELSE '' END" for bit, word, kinds in D.ACCESS if kind in kinds)


@query(f"SELECT p_partkey, {_access_sql('c')} AS of_class, {_access_sql('m')} AS of_method, {_access_sql('f')} AS of_field FROM (SELECT p_partkey, (p_size * 1299 + p_partkey) % 65536 AS f FROM part)")
def access_flags_text(spark, sf_dir):
    f = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") * 1299 + F.col("p_partkey")) % 65536).alias("f"))
    return f.select("p_partkey", *[D.access_text(F.col("f"), k[0]).alias(f"of_{k}") for k in ("class", "method", "field")])


@query("SELECT o_orderkey, printf('0x%x', o_custkey) AS positive, CASE WHEN o_custkey = 0 THEN '0x0' ELSE '0x' || right(printf('%016x', -o_custkey), 8) END AS negative, printf('0x%x', o_orderkey * 1000003) || 'L' AS wide, o_custkey::VARCHAR AS plain FROM orders")
def int_literal_hex(spark, sf_dir):
    key = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", L.int_literal(key).alias("positive"), L.int_literal(-key).alias("negative"), L.long_literal(F.col("o_orderkey") * 1000003).alias("wide"), L.int_literal(key, False).alias("plain"))


@query(r"""SELECT conv_id, turn, '"' || list_aggregate(list_transform(string_split(text || chr(9) || '"\' || chr(10) || chr(233), ''), lambda c: CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t'
 WHEN unicode(c) > 126 OR unicode(c) < 32 THEN '\u' || printf('%04x', unicode(c)) ELSE c END), 'string_agg', '') || '"' AS literal FROM conversations""")
def string_literal_escape(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit('\t"\\\né'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", L.string_literal(text).alias("literal"))


@query("SELECT conv_id, turn, substr(j, 2, length(j) - 2) AS body FROM (SELECT conv_id, turn, to_json(text)::VARCHAR AS j FROM conversations)")
def json_escape(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", N.json_body(F.col("text")).alias("body"))


@query("""SELECT r_name, to_json({'name': r_name, 'nations': list(n_name ORDER BY n_nationkey)})::VARCHAR AS json FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def json_export(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    return both.select("r_name", F.to_json(F.struct(F.col("r_name").alias("name"), F.col("m.n_name").alias("nations"))).alias("json"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 1e7 THEN NULL ELSE o_totalprice::VARCHAR || 'd' END AS literal FROM orders")
def double_literals(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") < 1e7, L.double_literal(F.col("o_totalprice"))).alias("literal"))


# ---- control flow: an order is a unit, its lines are instructions

_HANDLERS = """h AS (SELECT o_orderkey AS unit, 0 AS a, 2 AS b, o_custkey % 5 AS pc, CASE WHEN o_custkey % 3 <> 0 THEN 'E' || o_custkey % 2 END AS type, 0 AS ord FROM orders
 UNION ALL SELECT o_orderkey, 1, 4, o_custkey % 3, CASE WHEN o_custkey % 7 <> 0 THEN 'F' END, 1 FROM orders)"""


def _code_sql(more: str = "") -> str:
    """`more` adds leaders to those of the instructions."""
    return f"""code AS (SELECT unit, off, n, CASE op WHEN 'A' THEN 'fall' WHEN 'N' THEN 'cond' ELSE 'jump' END AS op, CASE WHEN op <> 'A' AND goal < n THEN goal END AS target FROM (
 SELECT l_orderkey AS unit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS off, count(*) OVER (PARTITION BY l_orderkey) AS n, l_returnflag AS op, l_partkey % 7 AS goal FROM lineitem)),
lead_at AS (SELECT unit, 0 AS off FROM code UNION SELECT unit, target FROM code WHERE target IS NOT NULL UNION SELECT unit, off + 1 FROM code WHERE op <> 'fall' AND off + 1 < n{more}),
num AS (SELECT code.*, sum(CASE WHEN lead_at.off IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY code.unit ORDER BY code.off) - 1 AS block_id FROM code LEFT JOIN lead_at USING (unit, off)),
blk AS (SELECT unit, block_id, min(off) AS start_off, max(n) AS n, arg_max(op, off) AS last_op, arg_max(coalesce(target, -1), off) AS last_target FROM num GROUP BY unit, block_id),
blocks AS (SELECT *, coalesce(lead(start_off) OVER (PARTITION BY unit ORDER BY block_id), n) AS end_off FROM blk),
edges AS (SELECT b.unit, b.block_id AS src, t.block_id AS dst, min(b.ord) AS ord FROM (SELECT unit, block_id, last_target AS goal, 0 AS ord FROM blocks WHERE last_op <> 'fall' AND last_target >= 0 UNION ALL SELECT unit, block_id, end_off, 1 FROM blocks WHERE last_op <> 'jump') b
  JOIN blocks t ON t.unit = b.unit AND t.start_off = b.goal GROUP BY ALL)"""


_CODE = _code_sql()
_HANDLED = f"{_HANDLERS}, {_code_sql(' UNION SELECT unit, unnest([a, b, pc]) FROM h')}"


def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as exception tables: two rows for each unit of code()."""
    key = F.col("o_custkey")
    first = F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), (key % 5).cast("int").alias("pc"), F.when(key % 3 != 0, F.concat(F.lit("E"), (key % 2).cast("string"))).alias("type"), F.lit(0).alias("ord"))
    second = F.struct(F.lit(1).alias("start"), F.lit(4).alias("end"), (key % 3).cast("int").alias("pc"), F.when(key % 7 != 0, F.lit("F")).alias("type"), F.lit(1).alias("ord"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.inline(F.array(first, second)))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as instruction rows; lines repeat, so the order of a unit is total over all their columns."""
    rows = table(spark, sf_dir, "lineitem")
    unit = Window.partitionBy("l_orderkey")
    order = unit.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = rows.withColumn("off", (F.row_number().over(order) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(unit))
    op = F.when(F.col("l_returnflag") == "A", "fall").when(F.col("l_returnflag") == "N", "cond").otherwise("jump")
    goal = F.col("l_partkey") % 7
    return rows.select(F.col("l_orderkey").alias("unit"), "off", "n", op.alias("op"), F.when((op != "fall") & (goal < F.col("n")), goal).alias("target"))


@query(f"WITH {_CODE} SELECT unit, off::BIGINT AS off FROM lead_at")
def leaders(spark, sf_dir):
    return cfg.leaders(code(spark, sf_dir))


@query(f"WITH {_CODE} SELECT unit, block_id::BIGINT AS block_id, start_off::BIGINT AS start_off, end_off::BIGINT AS end_off, last_op FROM blocks")
def blocks(spark, sf_dir):
    return cfg.blocks(code(spark, sf_dir)).drop("last_target")


@query(f"WITH {_CODE} SELECT c.unit, c.off::BIGINT AS off, b.block_id::BIGINT AS block_id FROM code c JOIN blocks b ON c.unit = b.unit AND c.off >= b.start_off AND c.off < b.end_off")
def insn_to_block_range(spark, sf_dir):
    return cfg.numbered(code(spark, sf_dir)).select("unit", "off", "block_id")


@query(f"WITH {_CODE} SELECT unit, src::BIGINT AS src, dst::BIGINT AS dst, ord::INTEGER AS ord FROM edges")
def edges(spark, sf_dir):
    return cfg.edges(cfg.blocks(code(spark, sf_dir)))


@query(f"WITH {_CODE} SELECT unit, dst::BIGINT AS dst, string_agg(DISTINCT src, ',' ORDER BY src) AS preds, min(ord) = 0 AS jump_target FROM edges GROUP BY unit, dst")
def predecessors(spark, sf_dir):
    found = cfg.predecessors(cfg.edges(cfg.blocks(code(spark, sf_dir))))
    return found.select("unit", "dst", F.array_join(F.col("preds").cast("array<string>"), ",").alias("preds"), "jump_target")


_ENTRIES = "entry AS (SELECT DISTINCT b.unit, b.block_id FROM h JOIN blocks b ON b.unit = h.unit AND b.start_off = h.pc)"


@query(f"WITH RECURSIVE {_HANDLED}, {_ENTRIES}, r(unit, node) AS (SELECT DISTINCT unit, 0::HUGEINT FROM blocks UNION SELECT unit, block_id FROM entry UNION SELECT r.unit, e.dst FROM r JOIN edges e ON e.unit = r.unit AND e.src = r.node) SELECT unit, node::BIGINT AS node FROM r")
def block_reachability(spark, sf_dir):
    """From block 0 and from the handlers of every unit."""
    handlers = exceptions(spark, sf_dir)
    found = cfg.blocks(code(spark, sf_dir), handlers)
    return cfg.reachable(found, cfg.edges(found), cfg.handler_blocks(found, handlers)).distinct()


@query(f"""WITH {_HANDLED}, o AS (SELECT unit, pc, coalesce(type, 'any') AS type, min(ord) AS ord, max(ord) AS last FROM h GROUP BY ALL),
p AS (SELECT unit, pc, string_agg(type, ',' ORDER BY ord) AS types, arg_max(type, last) AS last FROM o GROUP BY unit, pc)
SELECT p.unit, b.block_id::BIGINT AS block_id, CASE WHEN last = 'any' THEN 'finally' ELSE 'catch' END AS kind, types FROM p JOIN blocks b ON b.unit = p.unit AND b.start_off = p.pc""")
def handler_kinds(spark, sf_dir):
    handlers = exceptions(spark, sf_dir)
    found = cfg.handler_blocks(cfg.blocks(code(spark, sf_dir), handlers), handlers)
    return found.select("unit", "block_id", "kind", F.array_join("catch_types", ",").alias("types"))


@query(f"WITH {_HANDLED} SELECT unit, block_id::BIGINT AS block_id, start_off::BIGINT AS start_off, end_off::BIGINT AS end_off FROM blocks")
def handled_blocks(spark, sf_dir):
    """Blocks that also begin where the exception table says."""
    return cfg.blocks(code(spark, sf_dir), exceptions(spark, sf_dir)).select("unit", "block_id", "start_off", "end_off")


@query(f"""WITH {_HANDLED}, t AS (SELECT DISTINCT unit, a, b FROM h)
SELECT k.unit, k.block_id::BIGINT AS block_id, t.a::BIGINT AS first, t.b::BIGINT AS last FROM blocks k JOIN t ON t.unit = k.unit AND t.a <= k.start_off AND k.end_off <= t.b QUALIFY row_number() OVER (PARTITION BY k.unit, k.block_id ORDER BY t.a, t.b) = 1""")
def try_blocks(spark, sf_dir):
    """The first try range that holds a whole block."""
    handlers = exceptions(spark, sf_dir)
    return cfg.held_blocks(cfg.blocks(code(spark, sf_dir), handlers), handlers.select("unit", F.col("start").alias("first"), F.col("end").alias("last")))


@query(f"""WITH {_CODE}, l AS (SELECT l_orderkey AS unit, l_linenumber % 4 AS spot, l_linenumber AS line, l_partkey AS ord FROM lineitem),
f AS (SELECT unit, spot, line FROM l QUALIFY row_number() OVER (PARTITION BY unit, spot ORDER BY ord, line) = 1)
SELECT b.unit, b.block_id::BIGINT AS block_id, f.line::BIGINT AS line FROM blocks b LEFT JOIN f ON f.unit = b.unit AND f.spot = b.start_off""")
def line_at_blocks(spark, sf_dir):
    """The first line number that stands at a block's start."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), (F.col("l_linenumber") % 4).cast("long").alias("at"), F.struct("l_partkey", "l_linenumber").alias("ord"), F.col("l_linenumber").cast("long").alias("line"))
    return cfg.at_starts(cfg.blocks(code(spark, sf_dir)), rows, "at").select("unit", "block_id", "line")


@query(f"""WITH {_CODE}, m AS (SELECT unit, block_id, CASE WHEN last_op <> 'jump' THEN block_id END AS live FROM blocks)
SELECT unit, block_id::BIGINT AS block_id, (min(live) OVER (PARTITION BY unit ORDER BY block_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))::BIGINT AS next_live FROM m""")
def next_unconsumed(spark, sf_dir):
    """Behind each block the first whose end is no jump."""
    found = cfg.blocks(code(spark, sf_dir))
    return cfg.next_live(found.select("unit", "block_id", F.col("block_id").alias("pos")), found.filter("last_op = 'jump'"))


@query(f"WITH {_CODE}, inside AS (SELECT unit, block_id FROM blocks WHERE block_id < 3) SELECT e.unit, src::BIGINT AS src, dst::BIGINT AS dst FROM edges e SEMI JOIN inside i ON e.unit = i.unit AND e.src = i.block_id WHERE dst > 3")
def clean_region(spark, sf_dir):
    found = cfg.blocks(code(spark, sf_dir))
    region = found.filter("block_id < 3").select("unit", "block_id")
    return cfg.leaving(cfg.edges(found), region, found.filter("block_id = 3").select("unit", "block_id")).select("unit", "src", "dst")


@query(f"WITH {_CODE} SELECT c.unit, c.off::BIGINT AS off, b.block_id::BIGINT AS line FROM code c LEFT JOIN blocks b ON c.unit = b.unit AND c.off = b.start_off")
def line_lookup(spark, sf_dir):
    c = code(spark, sf_dir)
    starts = cfg.blocks(c).select("unit", F.col("start_off").alias("off"), F.col("block_id").alias("line"))
    return c.select("unit", "off").join(starts, ["unit", "off"], "left")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and edges per unit."""
    found = cfg.blocks(code(spark, sf_dir))
    per_unit = found.groupBy("unit").agg(F.count(F.lit(1)).alias("blocks"))
    return per_unit.join(cfg.edges(found).groupBy("unit").agg(F.count(F.lit(1)).alias("edges")), "unit", "left").select("unit", "blocks", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


QUERIES["cfg_size"] = flagship
ORACLE_SQL["cfg_size"] = f"WITH {_CODE} SELECT b.unit, b.n::BIGINT AS blocks, coalesce(e.n, 0)::BIGINT AS edges FROM (SELECT unit, count(*) AS n FROM blocks GROUP BY unit) b LEFT JOIN (SELECT unit, count(*) AS n FROM edges GROUP BY unit) e USING (unit)"


# ---- handlers, slots and frames over events and lines

@query("""WITH h AS (SELECT user_id AS unit, (event_id % 4)::INTEGER AS a, (event_id % 4 + 2)::INTEGER AS b, (event_id % 3)::INTEGER AS pc, event_type AS type, event_id AS ord FROM events),
o AS (SELECT unit, a, b, pc, type, min(ord) AS ord FROM h GROUP BY ALL)
SELECT unit, a AS first, b AS last, string_agg(pc || ':' || type, ',' ORDER BY ord) AS handlers FROM o GROUP BY unit, a, b""")
def handler_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), (F.col("event_id") % 4).cast("int").alias("start"), (F.col("event_id") % 4 + 2).cast("int").alias("end"), (F.col("event_id") % 3).cast("int").alias("pc"), F.col("event_type").alias("type"), F.col("event_id").alias("ord"))
    merged = cfg.merge_handlers(rows)
    text = F.array_join(F.transform("handlers", lambda h: F.concat_ws(":", h["pc"].cast("string"), h["type"])), ",")
    return merged.select("unit", F.col("start").alias("first"), F.col("end").alias("last"), text.alias("handlers"))


_TRY = "t AS (SELECT DISTINCT user_id AS unit, event_id % 50 AS a, event_id % 50 + event_id % 7 + 3 AS b FROM events), p AS (SELECT user_id AS unit, event_id, event_id % 60 AS lo, event_id % 60 + 2 AS hi FROM events)"


@query(f"WITH {_TRY} SELECT p.unit, p.event_id, t.a::BIGINT AS first, t.b::BIGINT AS last FROM p JOIN t ON p.unit = t.unit AND t.a <= p.lo AND p.hi <= t.b QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY t.a, t.b) = 1")
def try_containment(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "unit")
    tries = e.select("unit", (F.col("event_id") % 50).alias("first"), (F.col("event_id") % 50 + F.col("event_id") % 7 + 3).alias("last"))
    points = e.select("unit", F.col("event_id").alias("block_id"), (F.col("event_id") % 60).alias("start_off"), (F.col("event_id") % 60 + 2).alias("end_off"))
    return cfg.held_blocks(points, tries).withColumnRenamed("block_id", "event_id")


_GRAPH = "g AS (SELECT s_suppkey AS src, (s_suppkey * 3 + s_nationkey) % 97 AS dst FROM supplier)"


def _graph(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 3 + F.col("s_nationkey")) % 97).alias("dst"))


@query(f"WITH RECURSIVE {_GRAPH}, r(root, node) AS (SELECT DISTINCT src, src FROM g UNION SELECT r.root, g.dst FROM r JOIN g ON g.src = r.node) SELECT root, node::BIGINT AS node FROM r")
def reachability(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return closure(g, g.select(F.col("src").alias("root"), F.col("src").alias("node")), ["root"])


@query(f"WITH RECURSIVE {_GRAPH}, b AS (SELECT src AS latch, dst AS header FROM g WHERE dst <= src), r(header, node) AS (SELECT header, latch FROM b UNION SELECT r.header, g.src FROM r JOIN g ON g.dst = r.node WHERE r.node <> r.header) SELECT header::BIGINT AS header, node::BIGINT AS node FROM r UNION SELECT header, header FROM b")
def loop_body(spark, sf_dir):
    g = _graph(spark, sf_dir)
    latches = g.filter("dst <= src").select(F.col("dst").alias("header"), F.col("src").alias("node"))
    back = g.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(back, latches, ["header"], stop="node = header").unionByName(latches.select("header", F.col("header").alias("node"))).distinct()


@query("""WITH l AS (SELECT DISTINCT user_id AS unit, event_id % 11 AS label FROM events WHERE event_type <> 'click'), j AS (SELECT DISTINCT user_id AS unit, event_id % 11 AS label FROM events WHERE event_type = 'click') SELECT unit, label::BIGINT AS label FROM l EXCEPT SELECT unit, label FROM j""")
def dead_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), (F.col("event_id") % 11).alias("label"), "event_type")
    return e.filter("event_type <> 'click'").select("unit", "label").distinct().join(e.filter("event_type = 'click'").select("unit", "label"), ["unit", "label"], "left_anti")


@query(f"WITH {_CODE} SELECT unit, (off % 4)::BIGINT AS slot, count(*) FILTER (op = 'cond')::BIGINT AS writes, coalesce(min(off) FILTER (op <> 'cond') < min(off) FILTER (op = 'cond'), count(*) FILTER (op = 'cond') = 0) AS read_first FROM code GROUP BY unit, off % 4")
def slot_writes(spark, sf_dir):
    return cfg.slot_uses(code(spark, sf_dir).withColumn("store", F.col("op") == "cond").withColumn("slot", F.col("off") % 4), ["unit", "slot"])


@query("SELECT l_orderkey AS unit, 'v' || l_partkey % 5 AS name, coalesce(sum(l_linenumber) FILTER (l_returnflag <> 'N'), 0)::BIGINT AS reads, coalesce(sum(l_linenumber) FILTER (l_returnflag = 'N'), 0)::BIGINT AS writes FROM lineitem GROUP BY ALL")
def name_uses(spark, sf_dir):
    """How often each name is read and written in a unit's statements."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.concat(F.lit("v"), (F.col("l_partkey") % 5).cast("string")).alias("name"), (F.col("l_returnflag") == "N").alias("write"), F.col("l_linenumber").cast("long").alias("times"))
    return cfg.name_uses(rows, ["unit", "name"])


@query("SELECT p_partkey, p_name || CASE WHEN k > 1 THEN '$' || (k - 1) ELSE '' END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS k FROM part)")
def name_uniquify(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_name").alias("name"))
    return naming.uniquify(named, "p_brand", ["p_partkey"]).select("p_partkey", F.col("unique").alias("unique_name"))


@query("SELECT user_id, event_id, (sum(event_id % 60 + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS off FROM events")
def frame_offsets(spark, sf_dir):
    line = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.sum(F.col("event_id") % 60 + 1).over(line) - 1).alias("off"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING))::BIGINT AS idx FROM lineitem")
def diff_decode(spark, sf_dir):
    """Index differences, as class data of dex files has them, summed up per unit."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.sum(F.col("l_quantity").cast("long")).over(line).alias("idx"))


@query("SELECT user_id AS unit, (event_id % 5)::BIGINT AS target, string_agg(DISTINCT event_id % 13, ',' ORDER BY event_id % 13) AS cases FROM events GROUP BY user_id, event_id % 5")
def switch_arms(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("unit"), (F.col("event_id") % 5).alias("target")).agg(F.sort_array(F.collect_set(F.col("event_id") % 13)).alias("keys"))
    return e.select("unit", "target", F.array_join(F.col("keys").cast("array<string>"), ",").alias("cases"))


@query("SELECT 'customer' AS origin, c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, NULL FROM supplier")
def union_members(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True)


@query(f"""SELECT package, string_agg(DISTINCT simple, ',' ORDER BY simple) AS imports FROM (SELECT regexp_extract(p, '^([^/]*)', 1) AS package, regexp_extract(p, '([^/]*)$', 1) AS simple FROM (SELECT {_PATH} AS p FROM pages)) WHERE simple <> '' AND simple <> package GROUP BY package""")
def imports_set(spark, sf_dir):
    p = package_split(spark, sf_dir).select(F.regexp_extract("package", "^([^/]*)", 1).alias("package"), "simple").filter("simple <> '' and simple <> package")
    return p.groupBy("package").agg(F.array_join(F.sort_array(F.collect_set("simple")), ",").alias("imports"))


_LEB = "list_reduce(list_prepend('', list_transform(range({n}), lambda i: printf('%02x', (({v} >> (7 * i)) & 127) + CASE WHEN i < {n} - 1 THEN 128 ELSE 0 END))), lambda a, b: a || b)"


@query(f"""WITH k AS (SELECT o_orderkey, o_custkey * 977 + o_orderkey AS v, CASE WHEN o_custkey * 977 + o_orderkey < 128 THEN 1 WHEN o_custkey * 977 + o_orderkey < 16384 THEN 2 WHEN o_custkey * 977 + o_orderkey < 2097152 THEN 3 WHEN o_custkey * 977 + o_orderkey < 268435456 THEN 4 ELSE 5 END AS n FROM orders)
SELECT o_orderkey, {_LEB.format(n="n", v="v")} AS coded, v::BIGINT AS unsigned, (v - 1)::BIGINT AS plus_one, (CASE WHEN n < 5 AND (v >> (7 * n - 1)) & 1 = 1 THEN v - (1::BIGINT << (7 * n)) ELSE v END)::BIGINT AS signed FROM k""")
def leb128_roundtrip(spark, sf_dir):
    """Numbers as LEB128 bytes, and the three readings of those bytes by the reader of dex files."""
    import pyarrow as pa

    value = F.col("o_custkey") * 977 + F.col("o_orderkey")
    groups = F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7).cast("int"))
    byte = lambda i: F.call_function("shiftright", F.col("v"), i * 7).bitwiseAND(F.lit(127)) + F.when(i < F.col("n") - 1, 128).otherwise(0)
    coded = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.lower(F.lpad(F.hex(byte(i)), 2, "0"))), "")

    def run(batches):
        from .kernels.binary import Cursor

        for batch in batches:
            raw = [bytes.fromhex(x) for x in batch.column(1).to_pylist()]
            read = [[getattr(Cursor(x), how)() for x in raw] for how in ("uleb128", "uleb128p1", "sleb128")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(r, pa.int64()) for r in read)], ["o_orderkey", "coded", "unsigned", "plus_one", "signed"])

    rows = table(spark, sf_dir, "orders").select("o_orderkey", value.alias("v"), groups.alias("n")).select("o_orderkey", coded.alias("coded"))
    return rows.mapInArrow(run, "o_orderkey long, coded string, unsigned long, plus_one long, signed long")


# ---- binary kernels: parts are assembled to files, and the files are read

def _class_of_part(key: int, name: str, size: int) -> bytes:
    """Two constants, a sum, a limit inside a try range, and a method that gives back what it gets."""
    from .kernels.builder import ClassBuilder
    from .kernels.insn import assemble

    b = ClassBuilder(f"pkg/P{key}")
    b.field("size", "I", 0x19, b.number("int", size))
    b.field("name", "Ljava/lang/String;", 0x19, b.string(name))
    b.method("grow", "(I)I", assemble(("iload_0",), ("bipush", size), ("iadd",), ("ireturn",)), lines=((0, size),))
    clip = assemble(("iload_0",), ("bipush", size), ("if_icmple", 6), ("bipush", size), ("istore_0",), ("iload_0",), ("ireturn",), ("astore_1",), ("iconst_m1",), ("ireturn",))
    b.method("clip", "(I)I", clip, handlers=((0, 9, 11, "java/lang/Exception" if size % 2 else None),))
    b.method("same", "(I)I", assemble(("iload_0",), ("ireturn",)))
    return b.build()


def _units(spark, sf_dir, make=_class_of_part) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            key, name, size = (c.to_pylist() for c in batch.columns)
            data = [make(*x) for x in zip(key, name, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"P{k}.class" for k in key]), pa.array(["class"] * len(key)), pa.array(data, pa.binary())], ["unit_id", "origin", "kind", "data"])

    # a small file of parts is one split, and each of its rows becomes a file to assemble and read
    spread = max(32, 4 * spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").repartition(spread, "p_partkey").mapInArrow(run, "unit_id long, origin string, kind string, data binary")


@query("""SELECT p_partkey AS unit_id, 'pkg/P' || p_partkey AS name, 52::INTEGER AS major, 'java/lang/Object' AS super, 'size:I=' || p_size || ',name:Ljava/lang/String;=' || p_name AS fields, 'grow(I)I,clip(I)I,same(I)I' AS methods FROM part""")
def class_roundtrip(spark, sf_dir):
    from .plans import tables

    parsed = tables.parse_classes(_units(spark, sf_dir))
    f = F.array_join(F.transform("fields", lambda x: F.concat(x["name"], F.lit(":"), x["descriptor"], F.lit("="), x["const_text"])), ",")
    m = F.array_join(F.transform("methods", lambda x: F.concat(x["name"], x["descriptor"])), ",")
    return parsed.select("unit_id", "name", "major", "super", f.alias("fields"), m.alias("methods"))


@query("""SELECT p_partkey AS unit_id, m::INTEGER AS method_idx, off::INTEGER AS off, mnemonic, CASE WHEN mnemonic = 'bipush' THEN p_size::VARCHAR WHEN mnemonic = 'iconst_m1' THEN '-1' END AS value, targets FROM part,
 (VALUES (0, 0, 'iload_0', ''), (0, 1, 'bipush', ''), (0, 3, 'iadd', ''), (0, 4, 'ireturn', ''), (1, 0, 'iload_0', ''), (1, 1, 'bipush', ''), (1, 3, 'if_icmple', '9'), (1, 6, 'bipush', ''), (1, 8, 'istore_0', ''), (1, 9, 'iload_0', ''), (1, 10, 'ireturn', ''),
 (1, 11, 'astore_1', ''), (1, 12, 'iconst_m1', ''), (1, 13, 'ireturn', ''), (2, 0, 'iload_0', ''), (2, 1, 'ireturn', '')) v(m, off, mnemonic, targets)""")
def insn_roundtrip(spark, sf_dir):
    from .plans import tables

    rows = tables.insns(tables.parse_classes(_units(spark, sf_dir)))
    return rows.select("unit_id", "method_idx", "off", "mnemonic", "value", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


@query("SELECT p_partkey AS unit_id, 1::INTEGER AS method_idx, 0::INTEGER AS start_pc, 9::INTEGER AS end_pc, 11::INTEGER AS handler_pc, coalesce(CASE WHEN p_size % 2 = 1 THEN 'java/lang/Exception' END, 'any') AS catch_type, p_size::INTEGER AS line FROM part")
def handlers_and_lines(spark, sf_dir):
    from .plans import tables

    parsed = tables.parse_classes(_units(spark, sf_dir))
    lines = tables.line_numbers(parsed).select("unit_id", "line")
    return tables.handlers(parsed).join(lines, "unit_id").select("unit_id", "method_idx", "start_pc", "end_pc", "handler_pc", F.coalesce("catch_type", F.lit("any")).alias("catch_type"), "line")


@query("SELECT p_partkey AS unit_id, 'P' || p_partkey || '.jar!a/' || p_partkey || '.class' AS origin, 'class' AS kind, length(p_name)::BIGINT AS size, p_name AS body FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, 'P' || p_partkey || '.jar', 'error', NULL, NULL FROM part WHERE p_partkey % 7 = 0")
def zip_roundtrip(spark, sf_dir):
    """Every part is an archive with a directory, a text and a class entry; each seventh is cut short."""
    import pyarrow as pa

    from .plans import tables

    def run(batches):
        import io
        import zipfile

        for batch in batches:
            data = []
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED if key % 2 else zipfile.ZIP_STORED) as z:
                    z.writestr("a/", "")
                    z.writestr("a/notes.txt", "none")
                    z.writestr(f"a/{key}.class", name)
                data.append(raw.getvalue()[:-30] if key % 7 == 0 else raw.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"P{k}.jar" for k in batch.column(0).to_pylist()]), pa.array(data, pa.binary())], ["unit_id", "origin", "data"])

    archives = table(spark, sf_dir, "part").select("p_partkey", "p_name").mapInArrow(run, "unit_id long, origin string, data binary").withColumn("kind", F.lit("archive"))
    found = tables.explode_archives(archives)
    return found.select("unit_id", "origin", F.coalesce("kind", F.lit("error")).alias("kind"), F.octet_length("data").cast("long").alias("size"), F.col("data").cast("string").alias("body"))


@query("""SELECT p_partkey AS unit_id, 0::INTEGER AS method_idx, 'grow' AS name, '    0: iload_0' || chr(10) || '    1: bipush ' || p_size || chr(10) || '    3: iadd' || chr(10) || '    4: ireturn' || chr(10) || 'line ' || p_size || ': 0' AS listing FROM part
UNION ALL SELECT p_partkey, 1, 'clip', replace('    0: iload_0|    1: bipush ' || p_size || '|    3: if_icmple 9|    6: bipush ' || p_size || '|    8: istore_0|    9: iload_0|   10: ireturn|   11: astore_1|   12: iconst_m1|   13: ireturn|catch ' || CASE WHEN p_size % 2 = 1 THEN 'java/lang/Exception' ELSE 'any' END || ' 0..9 -> 11', '|', chr(10)) FROM part
UNION ALL SELECT p_partkey, 2, 'same', '    0: iload_0' || chr(10) || '    1: ireturn' FROM part""")
def disasm_text(spark, sf_dir):
    """The listings of every method."""
    from .plans import tables

    return tables.listings(tables.parse_classes(_units(spark, sf_dir))).select("unit_id", "method_idx", "name", "listing")


_SOURCE_SQL = r"""'package pkg;' || chr(10) || chr(10) || 'public class P' || p_partkey || ' {' || chr(10) || chr(9) || 'public static final int size = ' || p_size || ';' || chr(10) || chr(9) || 'public static final String name = "' || p_name || '";' || chr(10) || chr(10)
|| chr(9) || 'public static int grow(int arg0) {' || chr(10) || chr(9) || chr(9) || 'return arg0 + ' || p_size || ';' || chr(10) || chr(9) || '}' || chr(10)"""


_CAUGHT = "CASE WHEN p_size % 2 = 1 THEN 'Exception' ELSE 'Throwable' END"
_CLIP_SQL = f"""replace(replace('|~public static int clip(int arg0) {{|~~try {{|~~~if (arg0 > ' || p_size || ') {{|~~~~arg0 = ' || p_size || ';|~~~}}|~~~return arg0;|~~}} catch (' || {_CAUGHT} || ' caught) {{|~~~' || {_CAUGHT} || ' v1 = caught;|~~~return -1;|~~}}|~}}||~public static int same(int arg0) {{|~~return arg0;|~}}|}}|', '|', chr(10)), '~', chr(9))"""


@query(f"SELECT p_partkey AS unit_id, 'pkg/P' || p_partkey || '.java' AS file_name, {_SOURCE_SQL} || {_CLIP_SQL} AS text FROM part")
def decompile_source(spark, sf_dir):
    from .plans import tables

    return tables.sources(_units(spark, sf_dir)).select("unit_id", "file_name", "text")


@query("""SELECT p_partkey AS unit_id, '.class public LP' || p_partkey || ';' || chr(10) || '.super Ljava/lang/Object;' || chr(10) || '.field public static size:I' || chr(10) || '.method public static run()V' || chr(10) || '    0000: const/16 v1, ' || p_size || chr(10) || '    0002: sput v1, LP' || p_partkey || ';->size:I' || chr(10) || '    0004: return-void' || chr(10) || '.end method' AS listing FROM part""")
def dex_listing(spark, sf_dir):
    import pyarrow as pa

    from .plans import tables

    def run(batches):
        from .kernels import dexbuilder

        for batch in batches:
            key, size = (c.to_pylist() for c in batch.columns)
            data = [dexbuilder.build(f"LP{k};", {"run": [0x0113, s, 0x0167, 0, 0x000E]}, ("size",)) for k, s in zip(key, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["unit_id", "data"])

    units = table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInArrow(run, "unit_id long, data binary").withColumn("kind", F.lit("dex"))
    return tables.parse_dex(units).select("unit_id", "listing")


@query("""SELECT p_partkey AS unit_id, 7::INTEGER AS tag, 'pkg/P' || p_partkey AS text FROM part UNION ALL SELECT p_partkey, 7, 'java/lang/Object' FROM part UNION ALL SELECT p_partkey, 7, 'java/lang/Exception' FROM part WHERE p_size % 2 = 1 UNION ALL SELECT p_partkey, 8, p_name FROM part""")
def const_pool_resolve(spark, sf_dir):
    from .plans import tables

    return tables.resolved_pool(_units(spark, sf_dir)).select("unit_id", "tag", "text")


@query("""SELECT p_partkey AS unit_id, CASE WHEN p_partkey % 3 = 0 THEN 'no class file' WHEN p_partkey % 3 = 1 THEN 'short' END AS reason FROM part WHERE p_partkey % 3 < 2""")
def unit_errors(spark, sf_dir):
    """Of the assembled classes each third is text and each third cut in half; the rest parses."""
    from .plans import tables

    key = F.col("unit_id") % 3
    broken = F.when(key == 0, F.col("origin").cast("binary")).when(key == 1, F.substring("data", 1, F.octet_length("data") / 2)).otherwise(F.col("data"))
    found = tables.errors(tables.parse_classes(_units(spark, sf_dir).withColumn("data", broken)))
    return found.select("unit_id", F.when(F.col("message").startswith("no class file"), "no class file").otherwise("short").alias("reason"))


@query("""SELECT p_partkey, 'T extends Comparable<T> & Serializable' AS params, 'List<? extends ' || upper(p_type) || '>,int' || repeat('[]', p_size % 3) AS args, 'Map<String, ?>' AS ret FROM part""")
def signature_parse(spark, sf_dir):
    """Generic method signatures built from parts, and read."""
    import pyarrow as pa

    def run(batches):
        from .kernels.signature import parse

        for batch in batches:
            found = [parse(s) for s in batch.column(1).to_pylist()]
            columns = [[", ".join(x.type_params) for x in found], [",".join(x.args) for x in found], [x.ret for x in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["p_partkey", "params", "args", "ret"])

    text = F.concat(F.lit("<T::Ljava/lang/Comparable<TT;>;:Ljava/io/Serializable;>(Ljava/util/List<+Lx/"), F.upper("p_type"), F.lit(";>;"), F.repeat(F.lit("["), F.col("p_size") % 3), F.lit("I)Ljava/util/Map<Ljava/lang/String;*>;"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("s")).mapInArrow(run, "p_partkey long, params string, args string, ret string")


_KIND_NAMES = "(['int', 'Integer', 'Object', 'double', 'String[]', 'long', 'char', 'boolean'])"


@query(f"""WITH t AS (SELECT DISTINCT p_size % 8 AS i, {_KIND_NAMES}[p_size % 8 + 1] AS n FROM part), x AS (SELECT a.n AS target, b.n AS source FROM t a JOIN t b ON true)
SELECT target, source, target = source OR (target IN ('Integer', 'Object', 'String[]') AND source IN ('Integer', 'Object', 'String[]') AND (target = 'Object' OR (source LIKE '%[]' AND target NOT LIKE '%[]')))
 OR (target IN ('int', 'char', 'boolean') AND source IN ('int', 'char', 'boolean')) OR (target = 'long' AND source IN ('int', 'char', 'boolean')) OR (target = 'double' AND source IN ('int', 'char', 'long')) AS fits,
 CASE target WHEN 'int' THEN 'Integer' WHEN 'double' THEN 'Double' WHEN 'long' THEN 'Long' WHEN 'char' THEN 'Character' WHEN 'boolean' THEN 'Boolean' END AS box, CASE target WHEN 'Integer' THEN 'int' END AS unbox FROM x""")
def assignable_types(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("int", "Integer", "Object", "double", "String[]", "long", "char", "boolean")])
    t = table(spark, sf_dir, "part").select((F.col("p_size") % 8).alias("i")).distinct().select(names[F.col("i")].alias("n"))
    pairs = t.select(F.col("n").alias("target")).join(F.broadcast(t.select(F.col("n").alias("source"))))  # eight names
    return pairs.select("target", "source", D.assignable(F.col("target"), F.col("source")).alias("fits"), D.boxed(F.col("target")).alias("box"), D.unboxed(F.col("target")).alias("unbox"))


@query("""SELECT p_partkey, CASE WHEN f & 8192 <> 0 THEN 'annotation' WHEN f & 512 <> 0 THEN 'interface' WHEN f & 16384 <> 0 THEN 'enum' WHEN f & 1024 <> 0 THEN 'abstract' ELSE 'class' END AS kind, CASE WHEN p_size + 20 >= 45 THEN p_size - 24 ELSE 0 END::INTEGER AS jdk FROM (SELECT p_partkey, p_size, (p_size * 1299 + p_partkey) % 65536 AS f FROM part)""")
def class_kinds(spark, sf_dir):
    flags = (F.col("p_size") * 1299 + F.col("p_partkey")) % 65536
    return table(spark, sf_dir, "part").select("p_partkey", D.class_kind(flags).alias("kind"), D.jdk_version(F.col("p_size") + 20).alias("jdk"))
