"""Registered queries of predicates, attribute tables, dex tables, instruction sets and the facade, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import _class_of_part, _units, table
from .functions import descriptors as D
from .functions import literals as L
from .functions import names as N
from .operators import naming

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# ---- predicates and names

_TYPES = ("int", "boolean", "java.lang.String", "long", "void", "double", "char[]", "float", "byte", "short", "char")
_TYPE_SQL = f"([{_listed(_TYPES)}])[p_partkey % {len(_TYPES)} + 1]"


@query(f"""SELECT p_partkey, n AS name, n IN ({_listed(D.PRIMITIVES.values())}) AS primitive, n = 'void' AS void, n IN ('long', 'double') AS wide, n IN ('byte', 'short', 'char', 'int', 'long', 'float', 'double') AS numeric,
n IN ('boolean', 'byte', 'short', 'char', 'int') AS int_like, n IN ('float', 'double') AS float_like, n IN ('java.lang.String', 'char[]') AS reference FROM (SELECT p_partkey, {_TYPE_SQL} AS n FROM part)""")
def type_predicates(spark, sf_dir):
    name = F.array(*[F.lit(x) for x in _TYPES])[(F.col("p_partkey") % len(_TYPES)).cast("int")]
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).select("p_partkey", "name", *[c.alias(n) for n, c in D.type_flags(F.col("name")).items()])


_FLAGS_SQL = "(SELECT p_partkey, (p_size * 1299 + p_partkey * 7) % 524288 AS f FROM part)"


def _flags(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") * 1299 + F.col("p_partkey") * 7) % 524288).alias("f"))


@query("SELECT p_partkey, " + ", ".join(f"f & {bit} <> 0 AS is_{word}" for word, bit in D.BITS.items()) + f", f & 4096 <> 0 AS hidden, f & 262144 <> 0 AS data FROM {_FLAGS_SQL}")
def access_predicates(spark, sf_dir):
    f = F.col("f")
    return _flags(spark, sf_dir).select("p_partkey", *[c.alias(f"is_{n}") for n, c in D.access_flags(f).items()], D.hidden(f).alias("hidden"), D.access_text(f, "c").contains("data ").alias("data"))


_JAVA = ((1, "public"), (2, "private"), (4, "protected"), (8, "static"), (16, "final"), (1024, "abstract"), (256, "native"), (32, "synchronized"))


@query("SELECT p_partkey, concat_ws(' ', " + ", ".join(f"CASE WHEN f & {bit} <> 0 THEN '{word}' END" for bit, word in _JAVA) + f""") AS java, concat_ws(' ', CASE WHEN f & 64 <> 0 THEN 'bridge' END, CASE WHEN f & 128 <> 0 THEN 'varargs' END, CASE WHEN f & 4096 <> 0 THEN 'synthetic' END) AS other FROM {_FLAGS_SQL}""")
def modifiers_split(spark, sf_dir):
    return _flags(spark, sf_dir).select("p_partkey", D.modifiers(F.col("f"), "m").alias("m")).select("p_partkey", "m.java", "m.other")


@query("""SELECT p_partkey, repeat('[', p_size % 3) || 'Lpkg/' || p_type || ';' AS descriptor, CASE WHEN p_size % 3 > 0 THEN repeat('[', p_size % 3 - 1) || 'Lpkg/' || p_type || ';' END AS element,
CASE WHEN p_size % 3 = 0 THEN 'pkg/' || p_type ELSE repeat('[', p_size % 3) || 'Lpkg/' || p_type || ';' END AS class_name, 'Lpkg/' || p_type || ';' AS back FROM part""")
def descriptor_names(spark, sf_dir):
    d = F.concat(F.repeat(F.lit("["), F.col("p_size") % 3), F.lit("Lpkg/"), "p_type", F.lit(";"))
    return table(spark, sf_dir, "part").select("p_partkey", d.alias("descriptor"), D.element(d).alias("element"), D.class_of(d).alias("class_name"), D.descriptor_of(F.concat(F.lit("pkg."), "p_type")).alias("back"))


@query(r"""SELECT p_partkey, chr(39) || CASE c WHEN 34 THEN '"' WHEN 39 THEN '\' || chr(39) WHEN 92 THEN '\\' WHEN 10 THEN '\n' WHEN 13 THEN '\r' WHEN 9 THEN '\t' WHEN 0 THEN '\0' ELSE CASE WHEN c < 32 OR c > 126 THEN '\u' || printf('%04x', c) ELSE chr(c::INTEGER) END END || chr(39) AS literal
FROM (SELECT p_partkey, (p_partkey * 3) % 700 AS c FROM part)""")
def char_literals(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.char_literal((F.col("p_partkey") * 3) % 700).alias("literal"))


@query("SELECT o_orderkey, ((o_orderkey % 64000) / 16.0)::FLOAT::VARCHAR || 'f' AS literal, CASE o_orderkey % 3 WHEN 0 THEN 'Float.NaN' WHEN 1 THEN 'Float.POSITIVE_INFINITY' ELSE 'Float.MAX_VALUE' END AS special FROM orders")
def float_literals(spark, sf_dir):
    special = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 3 == 1, F.lit(float("inf"))).otherwise(F.lit(3.4028234663852886e38))
    return table(spark, sf_dir, "orders").select("o_orderkey", L.float_literal((F.col("o_orderkey") % 64000) / 16.0).alias("literal"), L.float_literal(special).alias("special"))


_HANDLE_SQL = "CASE p_size % 11 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in D.HANDLES.items()) + " ELSE 'unknown' END"
_TAGS = ("I", "Z", "s", "e", "c", "[", "@", "D")


@query(f"""SELECT p_partkey, {_HANDLE_SQL} AS handle, (['int', 'boolean', 'java.lang.String', 'pkg.' || p_type, 'java.lang.Class', 'java.lang.Object', 'java.lang.Object', 'double'])[p_partkey % 8 + 1] AS value_type, p_size % 2 = 0 AS override FROM part""")
def handles_and_values(spark, sf_dir):
    tag = F.array(*[F.lit(t) for t in _TAGS])[(F.col("p_partkey") % 8).cast("int")]
    annotation = F.when(F.col("p_size") % 2 == 0, "Ljava/lang/Override;").otherwise("Ljava/lang/Deprecated;")
    return table(spark, sf_dir, "part").select("p_partkey", D.handle_kind(F.col("p_size") % 11).alias("handle"), D.value_type(tag, F.concat(F.lit("Lpkg/"), "p_type", F.lit(";"))).alias("value_type"), D.is_override(annotation).alias("override"))


@query(f"SELECT event_id, level, list_position([{_listed(D.COMMENT_LEVELS)}], level) <= 3 AS shown, level = 'none' OR level = 'user_only' AS given FROM (SELECT event_id, ([{_listed(D.COMMENT_LEVELS)}])[event_id % 6 + 1] AS level FROM events)")
def comment_levels(spark, sf_dir):
    level = F.array(*[F.lit(x) for x in D.COMMENT_LEVELS])[(F.col("event_id") % 6).cast("int")]
    return table(spark, sf_dir, "events").select("event_id", level.alias("level")).select("event_id", "level", D.comment_allowed(F.upper("level"), "ERROR").alias("shown"), D.comment_allowed(F.col("level"), "user_only").alias("given"))


_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""SELECT page_id, d = 'example.com' OR starts_with(d, 'example.com.') OR d = 'site1' OR starts_with(d, 'site1.') OR d = 'www.a' OR starts_with(d, 'www.a.') AS skipped FROM (SELECT page_id, replace(CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END, '/', '.') AS d FROM (SELECT page_id, {_PATH} AS p FROM pages))""")
def packages_skipped(spark, sf_dir):
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", N.skip_package(N.package_of(p), ["example.com", "site1", "www/a"]).alias("skipped"))


# ---- naming

_NESTED = """c AS (SELECT r_name AS name FROM region UNION SELECT r_name || '$' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0
  UNION SELECT r_name || '$' || n_name || '$' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""WITH RECURSIVE {_NESTED}, up(name, top) AS (SELECT name, name FROM c UNION ALL SELECT up.name, o.name FROM up JOIN c o ON contains(up.top, '$') AND o.name = regexp_replace(up.top, '\\$[^$]*$', ''))
SELECT name, arg_min(top, length(top)) AS top FROM up GROUP BY name""")
def outermost_classes(spark, sf_dir):
    """The file that each class prints in: a gap in the names between ends the way out."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    inner = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    deep = supplier.join(inner, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.concat_ws("$", "r_name", "n_name", "s_name").alias("name"))
    near = inner.filter("n_nationkey % 4 <> 0").select(F.concat_ws("$", "r_name", "n_name").alias("name"))
    return naming.outermost(region.select(F.col("r_name").alias("name")).unionByName(near).unionByName(deep))


@query("SELECT n_regionkey, n_nationkey, n_name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation) WHERE k = 3")
def kth_member(spark, sf_dir):
    return naming.kth(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_name"], 2).select("n_regionkey", "n_nationkey", "n_name")


@query("""WITH d AS (SELECT l_orderkey AS g, 'n' || l_partkey % 3 || CASE WHEN l_suppkey % 4 = 0 THEN '$' || l_suppkey % 3 ELSE '' END AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY g, name ORDER BY ord) - 1 AS times FROM d),
t AS (SELECT g, list(DISTINCT name) AS taken FROM d GROUP BY g)
SELECT g, ord::BIGINT AS ord, name, CASE WHEN times = 0 THEN name ELSE name || '$' || (list_filter(range(1, times + len(taken) + 1), lambda i: NOT list_contains(taken, name || '$' || i)))[times] END AS unique_name FROM n JOIN t USING (g)""")
def name_collisions(spark, sf_dir):
    """Names some of which are numbered already: numbers that are taken are passed over."""
    name = F.concat(F.lit("n"), (F.col("l_partkey") % 3).cast("string"), F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("$"), (F.col("l_suppkey") % 3).cast("string"))).otherwise(""))
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), order.alias("ord"), name.alias("name"))
    return naming.uniquify(rows, "g", ["ord"]).select("g", "ord", "name", F.col("unique").alias("unique_name"))


# ---- attributes: parts are assembled to class files that carry all of them

def _attributed(key: int, name: str, size: int) -> bytes:
    import struct

    from .kernels.builder import ClassBuilder
    from .kernels.insn import assemble

    b = ClassBuilder(f"pkg/Q{key}")
    tag = b.annotation("Lpkg/Tag;", text=("s", b.utf8(name)), level=("I", b.number("int", size)))
    plain = b.annotation("Lpkg/Plain;")
    # same, append an int, one stack item (a long) at a distance of 3, full: a double and an object, a null on the stack
    frames = struct.pack(">HB", 4, size % 50) + struct.pack(">BHB", 252, 2, 1) + struct.pack(">BB", 64 + 3, 4) + struct.pack(">BHHBBHHB", 255, 1, 2, 3, 7, b.class_ref("pkg/Tag"), 1, 5)
    types = struct.pack(">HHHHHH", 1, 0, size, b.utf8("items"), b.utf8("Ljava/util/List<TT;>;"), 1)
    inner = [b.attribute("StackMapTable", frames), b.attribute("LocalVariableTypeTable", types)]
    params = struct.pack(">BHHHH", 2, b.utf8("first"), 16, 0, 4096)
    marked = struct.pack(">BH", 2, 1) + plain + struct.pack(">H", 0)
    b.field("old", "Ljava/util/List;", extra=[b.attribute("Deprecated", b""), b.shorts("Signature", b.utf8("Ljava/util/List<TT;>;")), b.attribute("RuntimeInvisibleAnnotations", struct.pack(">H", 1) + plain)])
    extra = [b.attribute("MethodParameters", params), b.attribute("RuntimeVisibleParameterAnnotations", marked)] + ([b.attribute("Synthetic", b"")] if size % 2 else [])
    b.method("both", "(II)V", assemble(("return",)), extra=extra, inner=inner)
    b.method("level", "()I", None, 0x401, extra=[b.attribute("AnnotationDefault", struct.pack(">BH", ord("I"), b.number("int", size)))])
    b.attrs.append(b.attribute("RuntimeVisibleAnnotations", struct.pack(">H", 1) + tag))
    b.attrs.append(b.shorts("InnerClasses", 2, b.class_ref(f"pkg/Q{key}$In"), b.class_ref(f"pkg/Q{key}"), b.utf8("In"), size % 8, b.class_ref(f"pkg/Q{key}$1"), 0, 0, 0))
    handle = b.handle(6, b.member("pkg/Boot", "link", "()V"))
    b.attrs.append(b.shorts("BootstrapMethods", 1, handle, 2, b.string(name), b.number("int", size)))
    b.attrs.append(b.shorts("EnclosingMethod", b.class_ref("pkg/Out"), b.name_type("run", "()V") if key % 2 else 0))
    b.attrs.append(b.attribute("Record", struct.pack(">HHHH", 1, b.utf8(f"c{size}"), b.utf8("Ljava/util/List;"), 1) + b.shorts("Signature", b.utf8("Ljava/util/List<TT;>;"))))
    b.attrs.append(b.shorts("NestHost", b.class_ref("pkg/Out")))
    b.attrs.append(b.shorts("NestMembers", 2, b.class_ref(f"pkg/M{size}"), b.class_ref("pkg/N")))
    b.attrs.append(b.shorts("PermittedSubclasses", 1, b.class_ref(f"pkg/S{size}")))
    return b.build()


def _attributes(spark, sf_dir, what: str) -> DataFrame:
    from .plans import attributes

    return attributes.table(attributes.parse_attributes(_units(spark, sf_dir, _attributed)), what)


def _flat(entries: str) -> F.Column:
    """A frame's entries as text: their tags, with the class of an object."""
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(" ", e["tag"], e["type"])), ",")


@query("""SELECT p_partkey AS unit_id, k::INTEGER AS ord, (CASE k WHEN 0 THEN d WHEN 1 THEN d + 3 WHEN 2 THEN d + 7 ELSE d + 9 END)::INTEGER AS off, locals, stack, CASE k WHEN 1 THEN 'int' WHEN 2 THEN 'int' WHEN 3 THEN 'double' END AS slot0, CASE k WHEN 3 THEN 'pkg.Tag' END AS slot2
FROM (SELECT p_partkey, p_size % 50 AS d FROM part), (VALUES (0, '', ''), (1, 'int', ''), (2, 'int', 'long'), (3, 'double,object pkg/Tag', 'null')) f(k, locals, stack)""")
def frames_table(spark, sf_dir):
    """Stack maps with running offsets and inherited locals, and the types of two local slots."""
    rows = _attributes(spark, sf_dir, "frames")
    return rows.select("unit_id", "ord", "off", _flat("locals").alias("locals"), _flat("stack").alias("stack"), D.local_type(F.col("locals"), F.lit(0)).alias("slot0"), D.local_type(F.col("locals"), F.lit(2)).alias("slot2"))


@query("""SELECT p_partkey AS unit_id, 'class' AS place, 0::INTEGER AS idx, true AS visible, 0::INTEGER AS ord, 'Lpkg/Tag;' AS type, '{"level": {"tag": "I", "value": ' || p_size || '}, "text": {"tag": "s", "value": "' || p_name || '"}}' AS "values" FROM part
UNION ALL SELECT p_partkey, 'field', 0, false, 0, 'Lpkg/Plain;', '{}' FROM part""")
def annotations_table(spark, sf_dir):
    return _attributes(spark, sf_dir, "annotations")


@query("""SELECT p_partkey AS unit_id, 0::INTEGER AS method_idx, 0::INTEGER AS param, true AS visible, 'Lpkg/Plain;' AS type, '{}' AS "values" FROM part""")
def parameter_annotations(spark, sf_dir):
    return _attributes(spark, sf_dir, "param_annotations")


@query("""SELECT p_partkey AS unit_id, 1::INTEGER AS method_idx, '{"tag": "I", "value": ' || p_size || '}' AS value FROM part""")
def annotation_defaults(spark, sf_dir):
    return _attributes(spark, sf_dir, "defaults")


@query("""SELECT p_partkey AS unit_id, 0::INTEGER AS ord, 'pkg/Q' || p_partkey || '$In' AS "inner", 'pkg/Q' || p_partkey AS "outer", 'In' AS name, (p_size % 8)::INTEGER AS access FROM part UNION ALL SELECT p_partkey, 1, 'pkg/Q' || p_partkey || '$1', NULL, NULL, 0 FROM part""")
def inner_classes(spark, sf_dir):
    return _attributes(spark, sf_dir, "inner_classes")


@query("SELECT p_partkey AS unit_id, 0::INTEGER AS ord, 2::INTEGER AS args, 'invokestatic' AS kind, p_name AS first FROM part")
def bootstrap_methods(spark, sf_dir):
    """Bootstrap methods with the kind of their handle and their first argument, a string, found in the pool."""
    from .plans import attributes

    first = F.get("args", F.lit(0))
    found = attributes.bootstraps(_units(spark, sf_dir, _attributed)).filter(F.col("kind").isNotNull() & (first["tag"] == 8) & first["text"].isNotNull())
    return found.select("unit_id", "ord", F.size("args").alias("args"), D.handle_kind(F.col("kind")).alias("kind"), first["text"].alias("first"))


@query("SELECT p_partkey AS unit_id, 'pkg/Out' AS \"class\", CASE WHEN p_partkey % 2 = 1 THEN 'run' END AS method, CASE WHEN p_partkey % 2 = 1 THEN '()V' END AS descriptor FROM part")
def enclosing_methods(spark, sf_dir):
    return _attributes(spark, sf_dir, "enclosing")


@query("SELECT p_partkey AS unit_id, 0::INTEGER AS ord, 'c' || p_size AS name, 'Ljava/util/List;' AS descriptor, 'Ljava/util/List<TT;>;' AS signature FROM part")
def record_components(spark, sf_dir):
    return _attributes(spark, sf_dir, "components")


@query("SELECT p_partkey AS unit_id, 'host' AS role, 0::INTEGER AS ord, 'pkg/Out' AS name FROM part UNION ALL SELECT p_partkey, 'member', 0, 'pkg/M' || p_size FROM part UNION ALL SELECT p_partkey, 'member', 1, 'pkg/N' FROM part UNION ALL SELECT p_partkey, 'permitted', 0, 'pkg/S' || p_size FROM part")
def nests(spark, sf_dir):
    host = _attributes(spark, sf_dir, "nest_host").select("unit_id", F.lit("host").alias("role"), F.lit(0).alias("ord"), "name")
    others = [_attributes(spark, sf_dir, what).select("unit_id", F.lit(role).alias("role"), "ord", "name") for what, role in (("nest_members", "member"), ("permitted", "permitted"))]
    return host.unionByName(others[0]).unionByName(others[1])


@query("SELECT p_partkey AS unit_id, 0::INTEGER AS method_idx, 0::INTEGER AS ord, 'first' AS name, 16::INTEGER AS access FROM part UNION ALL SELECT p_partkey, 0, 1, NULL, 4096 FROM part")
def method_parameters(spark, sf_dir):
    return _attributes(spark, sf_dir, "method_params")


@query("SELECT p_partkey AS unit_id, 0::INTEGER AS method_idx, 0::INTEGER AS start_pc, p_size::INTEGER AS length, 'items' AS name, 'Ljava/util/List<TT;>;' AS type, 1::INTEGER AS slot FROM part")
def variable_types(spark, sf_dir):
    return _attributes(spark, sf_dir, "variable_types")


@query("SELECT p_partkey AS unit_id, 'field' AS place, 0::INTEGER AS idx, true AS deprecated, false AS synthetic, 'Ljava/util/List<TT;>;' AS signature FROM part UNION ALL SELECT p_partkey, 'method', 0, false, p_size % 2 = 1, NULL FROM part UNION ALL SELECT p_partkey, 'method', 1, false, false, NULL FROM part")
def member_marks(spark, sf_dir):
    return _attributes(spark, sf_dir, "marks")


# ---- instruction sets and dex tables

@query("SELECT mnemonic, sum(n)::BIGINT AS times, bool_or(mnemonic IN ('bipush', 'iconst_m1')) AS const_load, bool_or(mnemonic = 'ireturn') AS unconditional, bool_or(mnemonic = 'if_icmple') AS conditional, false AS field_access FROM part, (VALUES ('iload_0', 4), ('bipush', 3), ('iadd', 1), ('ireturn', 4), ('if_icmple', 1), ('istore_0', 1), ('astore_1', 1), ('iconst_m1', 1)) v(mnemonic, n) GROUP BY mnemonic")
def opcode_join(spark, sf_dir):
    """Instructions joined with the table of the instruction set."""
    from .plans import dimensions, tables

    rows = tables.insns(tables.parse_classes(_units(spark, sf_dir))).select("opcode", "mnemonic")
    ops = F.broadcast(dimensions.jvm_opcodes(spark).drop("mnemonic", "sem"))  # 202 rows
    flags = [F.bool_or(c).alias(c) for c in ("const_load", "unconditional", "conditional", "field_access")]
    return rows.join(ops, "opcode").groupBy("mnemonic").agg(F.count(F.lit(1)).alias("times"), *flags)


@query("""SELECT * FROM (VALUES ('jvm', 202::BIGINT, 0::BIGINT, 16::BIGINT, 18::BIGINT), ('dex', 256, 32, 26, NULL)) t("set", codes, unused, layouts, may_jump)""")
def opcode_sets(spark, sf_dir):
    """How many codes, layouts and branches the two instruction sets have."""
    from .plans import dimensions

    jvm, dex = dimensions.jvm_opcodes(spark), dimensions.dex_opcodes(spark)
    one = jvm.agg(F.lit("jvm").alias("set"), F.count(F.lit(1)).alias("codes"), F.lit(0).cast("long").alias("unused"), F.count_distinct("layout").alias("layouts"), F.count_if("conditional").alias("may_jump"))
    return one.unionByName(dex.agg(F.lit("dex").alias("set"), F.count(F.lit(1)).alias("codes"), F.count_if(F.col("mnemonic").isNull()).alias("unused"), F.count_distinct("format").alias("layouts"), F.lit(None).cast("long").alias("may_jump")))


def _formats(s: int) -> list[tuple[str, list[int]]]:
    """(format, code units) of one instruction of each, with a part's size in it where there is room."""
    return [
        ("10x", [0x0000]), ("12x", [0x2101]), ("11n", [0xF112]), ("11x", [0x030A]), ("10t", [0x0228]), ("20t", [0x0029, s]), ("22x", [0x0302, s]), ("21t", [0x0138, 0xFFFF]), ("21s", [0x0113, s]),
        ("21h", [0x0115, s]), ("21c", [0x011A, 0]), ("23x", [0x012D, 0x0302]), ("22b", [0x01D8, s % 100 << 8 | 2]), ("22t", [0x2132, s]), ("22s", [0x21D0, s]), ("22c", [0x2120, 0]), ("32x", [0x0003, 300, s]),
        ("30t", [0x002A, s, 0]), ("31t", [0x012B, s, 0]), ("31i", [0x0114, s, 1]), ("31c", [0x011B, 0, 0]), ("35c", [0x2071, 0, 0x0021]), ("3rc", [0x0377, 0, 4]), ("45cc", [0x10FA, 0, 0x0005, 0]), ("4rcc", [0x02FB, 0, 7, 0]), ("51l", [0x0118, s, 0, 0, 0xFFFF]),
        ("end", [0x000E]),
    ]


# What they read as: name and operands, in SQL over p (the part), s (its size) and off.
_READ = {
    "10x": ("nop", "''"), "12x": ("move", "'v1, v2'"), "11n": ("const/4", "'v1, -1'"), "11x": ("move-result", "'v3'"), "10t": ("goto", "(off + 2)::VARCHAR"), "20t": ("goto/16", "(off + s)::VARCHAR"), "22x": ("move/from16", "'v3, v' || s"),
    "21t": ("if-eqz", "'v1, ' || (off - 1)"), "21s": ("const/16", "'v1, ' || s"), "21h": ("const/high16", "'v1, ' || s || '<<high16'"), "21c": ("const-string", "'v1, \"I\"'"), "23x": ("cmpl-float", "'v1, v2, v3'"),
    "22b": ("add-int/lit8", "'v1, v2, ' || s % 100"), "22t": ("if-eq", "'v1, v2, ' || (off + s)"), "22s": ("add-int/lit16", "'v1, v2, ' || s"), "22c": ("instance-of", "'v1, v2, I'"), "32x": ("move/16", "'v300, v' || s"),
    "30t": ("goto/32", "(off + s)::VARCHAR"), "31t": ("packed-switch", "'v1, ' || (off + s)"), "31i": ("const", "'v1, ' || (65536 + s)"), "31c": ("const-string/jumbo", "'v1, \"I\"'"), "35c": ("invoke-static", "'{v1, v2}, LP' || p || ';->run()V'"),
    "3rc": ("invoke-static/range", "'{v4 .. v6}, LP' || p || ';->run()V'"), "45cc": ("invoke-polymorphic", "'{v5}, LP' || p || ';->run()V, ()V'"), "4rcc": ("invoke-polymorphic/range", "'{v7 .. v8}, LP' || p || ';->run()V, ()V'"),
    "51l": ("const-wide", "'v1, ' || (s - (1::BIGINT << 48))"), "end": ("return-void", "''"),
}


def _offsets() -> str:
    """VALUES rows of the instructions with their offsets and names."""
    at, rows = 0, []
    for form, units in _formats(0):
        rows.append(f"('{form}', {at}, '{_READ[form][0]}')")
        at += len(units)
    return ", ".join(rows)


def _dexes(spark, sf_dir) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        from .kernels import dexbuilder

        for batch in batches:
            data = []
            for k, s in zip(*(c.to_pylist() for c in batch.columns)):
                tries = {"run": [(0, 4, [("Ljava/lang/Error;", 5)], None), (4, s, [], 9)]}
                data.append(dexbuilder.build(f"LP{k};", {"run": [u for _, units in _formats(s) for u in units]}, ("size",), tries=tries))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["unit_id", "data"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInArrow(run, "unit_id long, data binary").withColumn("kind", F.lit("dex"))


@query(f"""SELECT p AS unit_id, 'LP' || p || ';' AS class_name, 'run()V' AS method, off::INTEGER AS off, name, CASE form {' '.join(f"WHEN '{form}' THEN {text}" for form, (_, text) in _READ.items())} END AS text
FROM (SELECT p_partkey AS p, p_size AS s, form, off, name FROM part, (VALUES {_offsets()}) v(form, off, name))""")
def dex_formats(spark, sf_dir):
    """Instructions of every format."""
    from .plans import tables

    return tables.dex_insns(_dexes(spark, sf_dir)).drop("opcode")


@query("SELECT p_partkey AS unit_id, 'run()V' AS method, 0::INTEGER AS start, 4::INTEGER AS \"end\", 5::INTEGER AS handler, 'Ljava/lang/Error;' AS type FROM part UNION ALL SELECT p_partkey, 'run()V', 4, (4 + p_size)::INTEGER, 9, NULL FROM part")
def dex_try_items(spark, sf_dir):
    from .plans import tables

    return tables.dex_tries(_dexes(spark, sf_dir)).drop("class_name")


@query("""WITH n AS (SELECT p_partkey AS unit_id, 'LP' || p_partkey || ';' AS c FROM part)
SELECT unit_id, kind, idx::INTEGER AS idx, owner, CASE WHEN name = '*' THEN c ELSE name END AS name, descriptor FROM n, (VALUES ('string', 0, NULL, 'I', NULL), ('string', 1, NULL, '*', NULL), ('string', 2, NULL, 'Ljava/lang/Error;', NULL), ('string', 3, NULL, 'Ljava/lang/Object;', NULL), ('string', 4, NULL, 'V', NULL), ('string', 5, NULL, 'run', NULL), ('string', 6, NULL, 'size', NULL),
('type', 0, NULL, 'I', NULL), ('type', 1, NULL, '*', NULL), ('type', 2, NULL, 'Ljava/lang/Error;', NULL), ('type', 3, NULL, 'Ljava/lang/Object;', NULL), ('type', 4, NULL, 'V', NULL), ('proto', 0, NULL, NULL, '()V')) v(kind, idx, owner, name, descriptor)
UNION ALL SELECT unit_id, 'field', 0, c, 'size', 'I' FROM n UNION ALL SELECT unit_id, 'method', 0, c, 'run', '()V' FROM n""")
def dex_id_tables(spark, sf_dir):
    from .plans import tables

    return tables.dex_ids(_dexes(spark, sf_dir))


# ---- the facade

def _nested(key: int, name: str, size: int) -> bytes:
    """Three of four parts nest in the first of their four."""
    from .kernels.builder import ClassBuilder

    top = f"pkg/T{key - key % 4}"
    b = ClassBuilder(top if key % 4 == 0 else f"{top}$I{key}")
    b.field("size", "I", 0x19, b.number("int", size))
    return b.build()


def _engine(spark, sf_dir, make, **options):
    from .engine import Engine

    return Engine(spark, **options).add_table(_units(spark, sf_dir, make).withColumn("name", F.col("origin")))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey - p_partkey % 4 AS t, p_size AS s FROM part),
o AS (SELECT t, k, 'public static final int ' || CASE WHEN k % 3 = 0 THEN 'amount' ELSE 'size' END || ' = ' || s || ';' AS f, CASE WHEN t % 8 = 0 THEN 'Renamed' || t ELSE 'T' || t END AS n, 'package pkg;' || chr(10) || chr(10) AS head FROM p),
i AS (SELECT t, string_agg(chr(10) || chr(9) || 'public class I' || k || ' {' || chr(10) || chr(9) || chr(9) || f || chr(10) || chr(9) || '}' || chr(10), '' ORDER BY 'pkg/T' || t || '$I' || k) AS inside FROM o WHERE k <> t GROUP BY t)
SELECT 'pkg/' || n || '.java' AS file_name, head || '// part ' || t || chr(10) || 'public class ' || n || ' {' || chr(10) || chr(9) || f || chr(10) || coalesce(inside, '') || '}' || chr(10) AS text FROM o LEFT JOIN i USING (t) WHERE k = t
UNION ALL SELECT 'pkg/T' || t || '.java', head || 'public class T' || t || '.I' || k || ' {' || chr(10) || chr(9) || f || chr(10) || '}' || chr(10) FROM o WHERE k <> t AND t NOT IN (SELECT k FROM p)""")
def facade_sources(spark, sf_dir):
    """Files with their nested classes, renamed classes and fields, and comments above classes."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") - F.col("p_partkey") % 4).alias("t"))
    own = F.concat(F.lit("pkg/T"), F.col("t").cast("string"), F.when(F.col("k") == F.col("t"), "").otherwise(F.concat(F.lit("$I"), F.col("k").cast("string"))))
    none = F.lit(None).cast("int")
    fields = rows.filter("k % 3 = 0").select(F.lit("f").alias("kind"), F.concat(own, F.lit("#size:I")).alias("node"), none.alias("slot"), F.lit("amount").alias("alias"), F.col("k").alias("ord"))
    classes = rows.filter("t % 8 = 0 and k = t").select(F.lit("c").alias("kind"), own.alias("node"), none.alias("slot"), F.concat(F.lit("Renamed"), F.col("t").cast("string")).alias("alias"), F.col("k").alias("ord"))
    notes = rows.filter("k = t").select(F.lit("c").alias("kind"), own.alias("node"), F.lit(-1).alias("line"), F.concat(F.lit("part "), F.col("t").cast("string")).alias("text"), F.col("k").alias("ord"))
    engine = _engine(spark, sf_dir, _nested).add_map(fields.unionByName(classes), notes)
    return engine.sources.select("file_name", "text")


@query("SELECT 'pkg/P' || p_partkey AS class_name FROM part WHERE p_partkey < 10")
def facade_filter(spark, sf_dir):
    """The feature shown is a filter of classes: those it takes have sources, of all that are read."""
    return _engine(spark, sf_dir, _class_of_part, class_filter=[f"pkg.P{k}" for k in range(10)]).sources.select("class_name")


@query("SELECT count(*)::BIGINT AS classes, 1::BIGINT AS packages, (3 * count(*))::BIGINT AS methods, (2 * count(*))::BIGINT AS fields, 0::BIGINT AS errors, count(*)::BIGINT AS units FROM part")
def facade_counts(spark, sf_dir):
    return _engine(spark, sf_dir, _class_of_part).counts.select("classes", "packages", "methods", "fields", "errors", "units")


@query("SELECT 'pkg/P' || p_partkey AS name, 'pkg.P' || p_partkey AS full_name, 'pkg/P' || p_partkey || '.java' AS file_name, false AS is_interface, false AS is_record, 3::INTEGER AS n_methods, 2::INTEGER AS n_fields, 0::INTEGER AS n_errors, '' AS imports FROM part")
def facade_details(spark, sf_dir):
    rows = _engine(spark, sf_dir, _class_of_part).class_details
    return rows.select("name", "full_name", "file_name", "is_interface", "is_record", "n_methods", "n_fields", "n_errors", F.array_join("imports", ",").alias("imports"))


def _passes(key: int, name: str, size: int) -> bytes:
    """A step of a part's size, a return that says nothing, and in every second class a copy that waits on the stack."""
    from .kernels.builder import ClassBuilder
    from .kernels.insn import assemble

    b = ClassBuilder(f"pkg/S{key}")
    b.method("step", "(I)V", assemble(("iload_0",), ("bipush", size), ("iadd",), ("istore_0",), ("return",)))
    if key % 2:
        b.method("both", "(II)I", assemble(("iload_0",), ("ifeq", 7), ("iload_1",), ("goto", 5), ("bipush", size), ("ireturn",)))
    return b.build()


@query("SELECT p_partkey AS unit_id, (1 + p_partkey % 2)::BIGINT AS methods, 1::BIGINT AS returns_stripped, 1::BIGINT AS increments_folded, 0::BIGINT AS temps_inlined, 0::BIGINT AS labels FROM part")
def pass_counters(spark, sf_dir):
    """What the passes changed, per class; a value that meets on two ways is written twice and stays."""
    from .plans import tables

    rows = tables.pass_reports(_units(spark, sf_dir, _passes))
    return rows.groupBy("unit_id").agg(F.count(F.lit(1)).alias("methods"), *[F.sum(c).alias(c) for c in ("returns_stripped", "increments_folded", "temps_inlined", "labels")])


@query("""SELECT p_partkey AS unit_id, m::INTEGER AS method_idx, name, replace(replace('public static int ' || name || '(int arg0) {|' || CASE m WHEN 0 THEN '~return arg0 + ' || p_size || ';|' WHEN 2 THEN '~return arg0;|'
 ELSE '~try {|~~if (arg0 > ' || p_size || ') {|~~~arg0 = ' || p_size || ';|~~}|~~return arg0;|~} catch (' || kind || ' caught) {|~~' || kind || ' v1 = caught;|~~return -1;|~}|' END || '}', '|', chr(10)), '~', chr(9)) AS text
FROM (SELECT *, CASE WHEN p_size % 2 = 1 THEN 'Exception' ELSE 'Throwable' END AS kind FROM part), (VALUES (0, 'grow'), (1, 'clip'), (2, 'same')) v(m, name)""")
def method_texts(spark, sf_dir):
    """The sources of methods by themselves."""
    from .plans import tables

    return tables.method_sources(_units(spark, sf_dir)).select("unit_id", "method_idx", "name", "text")
