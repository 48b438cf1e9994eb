"""The facade: inputs in, tables, sources, listings and renames out. Everything is lazy until a table is asked for rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import descriptors as D
from .functions import names as N
from .kernels.decompile import Style
from .operators import naming
from .plans import attributes, dimensions, tables
from .plans.tables import resolve_pool  # noqa: F401 (part of the facade)
from .sources import renames as R
from .sources import units as U

VERSION = "0.2.0"
VERSION_PARTS = tuple(int(x) for x in VERSION.split("."))
LICENSE = "Apache-2.0"
REVISION = 2  # of the tables' columns

RENAME = "kind string, node string, alias string, ord long"
COMMENT = "kind string, node string, line int, text string, ord long"


@dataclass
class Options:
    """Only options that have an effect; an unknown key is an error."""

    class_filter: list[str] = field(default_factory=list)
    entry_limit: int = 64 << 20
    escape_unicode: bool = True
    integer_format: str = "decimal"  # auto (as decimal), decimal or hexadecimal
    use_imports: bool = True
    debug_names: bool = True
    line_numbers: bool = False
    comment_level: str = "debug"  # below user_only, given comments do not print
    rename_shorter_than: int = 0  # 0 renames nothing
    whitelist: list[str] = field(default_factory=list)
    force_whitelist: bool = False  # listed names are always renamed, instead of never
    skip_packages: list[str] = field(default_factory=list)  # whose classes keep their names
    show_synthetic: bool = True  # without it members that the compiler made are no rows of methods and fields

    @classmethod
    def of(cls, given: dict) -> Options:
        known = {f.name for f in fields(cls)}
        if wrong := sorted(set(given) - known):
            raise KeyError(f"unknown options: {', '.join(wrong)}")
        made = cls(**given)
        if D.integer_format(made.integer_format) is None or made.comment_level.lower() not in D.COMMENT_LEVELS:
            raise ValueError(f"no such word: {made.integer_format}, {made.comment_level}")
        return made

    @property
    def style(self) -> Style:
        return Style(self.escape_unicode, D.integer_format(self.integer_format) == "hexadecimal", self.use_imports, self.debug_names, self.line_numbers)


class Engine:
    def __init__(self, spark: SparkSession, **options):
        self.spark, self.options = spark, Options.of(options)
        self._paths: list[str] = []
        self._blobs: dict[str, bytes] = {}
        self._tables: list[DataFrame] = []
        self._parsed: DataFrame | None = None
        self._heads: DataFrame | None = None
        self._loaded: list[tuple[DataFrame, DataFrame]] = []
        self._renames: list[tuple] = []
        self._comments: list[tuple] = []
        self._log: Callable[[str], None] = lambda message: None
        self._progress: Callable[[int, int, str], None] = lambda done, total, name: None
        self.last_error: str | None = None

    # ---- inputs

    def add_path(self, path: str) -> Engine:
        self._paths.append(path)
        self._parsed = self._heads = None
        return self

    def add_bytes(self, name: str, data: bytes) -> Engine:
        self._blobs[name] = data
        self._parsed = self._heads = None
        return self

    def add_table(self, units: DataFrame) -> Engine:
        """Units from anywhere else: unit_id, origin, name, kind (class, dex or archive), data."""
        self._tables.append(units.select("unit_id", "origin", "name", "kind", "data"))
        self._parsed = self._heads = None
        return self

    def reset(self) -> Engine:
        """Forget inputs, renames and comments; options and callbacks stay."""
        self._paths, self._blobs, self._tables, self._parsed, self._heads = [], {}, [], None, None
        self._loaded, self._renames, self._comments, self.last_error = [], [], [], None
        return self

    def on_log(self, call: Callable[[str], None]) -> Engine:
        self._log = call
        return self

    def on_progress(self, call: Callable[[int, int, str], None]) -> Engine:
        """`call(done, total, name)` on the driver for every class that save() has written."""
        self._progress = call
        return self

    def _fail(self, error: Exception) -> Exception:
        self.last_error = str(error)
        self._log(self.last_error)
        return error

    @property
    def inputs(self) -> DataFrame:
        """unit_id, origin, name, kind, data of the files and blobs added; none at all is an error."""
        try:
            parts = ([U.read_units(self.spark, self._paths)] if self._paths else []) + ([U.blob_units(self.spark, self._blobs)] if self._blobs else []) + self._tables
            if not parts:
                raise ValueError("no input files")
        except (ValueError, FileNotFoundError) as e:
            raise self._fail(e) from None
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    @property
    def units(self) -> DataFrame:
        """The inputs with archives taken apart: entries get ids of their own."""
        found = self.inputs
        entries = tables.explode_archives(found, self.options.entry_limit).filter("error is null")
        entries = entries.select(F.xxhash64("origin").alias("unit_id"), "origin", "name", "kind", "data")
        return found.filter("kind in ('class', 'dex')").unionByName(entries)

    @property
    def parsed(self) -> DataFrame:
        if self._parsed is None:
            rows = tables.parse_classes(self.units)
            self._parsed = rows.filter(F.col("error").isNotNull() | self._accepted(F.col("name"))).cache()
        return self._parsed

    @property
    def heads(self) -> DataFrame:
        """tables.heads() of the classes that the filter takes; rows of errors stay."""
        if self._heads is None:
            rows = tables.heads(self.units)
            self._heads = rows.filter(F.col("error").isNotNull() | self._accepted(F.col("name"))).cache()
        return self._heads

    def _accepted(self, name) -> F.Column:
        return N.matches_any(F.translate(name, "/", "."), self.options.class_filter)

    @property
    def dex(self) -> DataFrame:
        """tables.parse_dex() of the classes that the filter takes; rows of errors stay."""
        rows = tables.parse_dex(self.units)
        return rows.filter(F.col("error").isNotNull() | self._accepted(D.class_of(F.col("name"))))

    # ---- tables

    @property
    def classes(self) -> DataFrame:
        """Classes of class files and dex files, with package, jdk and the class each is nested in, by name."""
        java = tables.classes(self.parsed).withColumn("jdk", D.jdk_version(F.col("major"))).withColumn("dex", F.lit(False))
        found = self.dex.filter("error is null")
        dex = found.select("unit_id", D.class_of(F.col("name")).alias("name"), "access", D.class_of(F.col("super")).alias("super"), F.transform("interfaces", D.class_of).alias("interfaces"), F.col("source").alias("source_file"), F.lit(True).alias("dex"))
        every = java.unionByName(dex, allowMissingColumns=True)
        linked = naming.link_nested(every.select("name", F.col("unit_id").alias("ord"))).select("name", "outer").distinct()
        return every.join(linked, "name", "left").withColumn("package", F.translate(N.package_of(F.col("name")), "/", ".")).orderBy("name", "unit_id")

    @property
    def class_details(self) -> DataFrame:
        """Of each class of a class file what a reader of one class asks: unit_id, name, full_name, origin, file_name, flags
        by name, counts of its methods, fields and errors, imports, and the listing of its code."""
        rows = self.parsed.filter("error is null")
        bad = F.size(F.filter("methods", lambda m: m["error"].isNotNull())).cast("int")
        counts = rows.select("unit_id", "name", N.source_name(F.col("name")).alias("full_name"), "access", F.size("methods").alias("n_methods"), F.size("fields").alias("n_fields"), bad.alias("n_errors"))
        components = attributes.parse_attributes(self.units).select("unit_id", F.size("components").alias("components"))
        flags = [c.alias(f"is_{n}") for n, c in D.class_flags(F.col("access"), F.col("components")).items()]
        both = counts.join(components, "unit_id").join(self.units.select("unit_id", "origin"), "unit_id").join(tables.class_texts(self.units), "unit_id")
        return both.select("unit_id", "name", "full_name", "origin", "file_name", *flags, "n_methods", "n_fields", "n_errors", "imports", "listing")

    def find_class(self, name: str) -> DataFrame:
        """The first class, by name, of that name; dots and slashes are one. No row where there is none."""
        return self.classes.filter(F.col("name").isin(name, name.replace(".", "/"))).limit(1)

    def class_at(self, k: int) -> DataFrame:
        """The class at place `k` of the order by name; no row beyond the last."""
        return self.classes.offset(k).limit(1) if k >= 0 else self.classes.limit(0)

    def member_index(self, class_name: str, name: str, kind: str = "m") -> int:
        """The place in its class of the first method (m) or field (f) of a name; -1 where there is none."""
        rows = self.methods if kind == "m" else self.fields
        return rows.filter((F.col("class_name") == class_name.replace(".", "/")) & (F.col("name") == name)).agg(F.coalesce(F.min("idx"), F.lit(-1))).first()[0]

    @property
    def counts(self) -> DataFrame:
        """One row: inputs, units, classes, packages, methods, fields, errors, renames, comments."""
        tables_of = {"inputs": self.inputs, "units": self.units, "classes": self.classes, "packages": self.packages, "methods": self.methods, "fields": self.fields, "errors": self.errors, "renames": self.rename_map, "comments": self.comments}
        out = None
        for name, rows in tables_of.items():
            one = rows.agg(F.count(F.lit(1)).alias(name)).withColumn("k", F.lit(0))
            out = one if out is None else out.join(one, "k")
        return out.drop("k")

    @property
    def packages(self) -> DataFrame:
        members = F.array_sort(F.collect_list("name")).alias("classes")
        return self.classes.groupBy("package").agg(F.count(F.lit(1)).alias("n"), members).orderBy("package")

    @property
    def methods(self) -> DataFrame:
        return self._members(tables.methods, "")

    @property
    def fields(self) -> DataFrame:
        return self._members(tables.fields, ":")

    def _members(self, of, mark: str) -> DataFrame:
        """Members with their id: class#name and descriptor."""
        owner = tables.classes(self.parsed).select("unit_id", F.col("name").alias("class_name"))
        rows = of(self.parsed).filter(~D.hidden(F.col("access"), self.options.show_synthetic))
        return rows.join(owner, "unit_id").withColumn("id", F.concat("class_name", F.lit("#"), "name", F.lit(mark), "descriptor"))

    @property
    def method_sources(self) -> DataFrame:
        """class_name, method_idx, name, descriptor, text: each method's source by itself."""
        owner = tables.classes(self.parsed).select("unit_id", F.col("name").alias("class_name"))
        return tables.method_sources(self.units, self.options.style).join(owner, "unit_id").drop("unit_id")

    def attribute(self, what: str) -> DataFrame:
        """A table of attributes.SHAPE, such as frames, annotations, inner_classes or bootstrap, of the accepted classes."""
        rows = attributes.table(attributes.parse_attributes(self.units), what)
        return rows.join(tables.classes(self.parsed).select("unit_id"), "unit_id", "left_semi")

    @property
    def opcodes(self) -> DataFrame:
        return dimensions.jvm_opcodes(self.spark)

    @property
    def dex_opcodes(self) -> DataFrame:
        return dimensions.dex_opcodes(self.spark)

    @property
    def nodes(self) -> DataFrame:
        """kind, node of everything that a rename or a comment can name."""
        classes = tables.classes(self.parsed).select(F.lit("c").alias("kind"), F.col("name").alias("node"))
        members = [rows.select(F.lit(kind).alias("kind"), F.col("id").alias("node")) for kind, rows in (("f", self.fields), ("m", self.methods))]
        return classes.unionByName(members[0]).unionByName(members[1])

    @property
    def pool(self) -> DataFrame:
        """The constant pools as lines."""
        return tables.pool_lines(tables.const_pool(self.parsed))

    @property
    def instructions(self) -> DataFrame:
        return tables.insns(self.parsed)

    @property
    def listings(self) -> DataFrame:
        return tables.listings(self.parsed)

    @property
    def files(self) -> DataFrame:
        """unit_id, files, aliases, notes of each source file to print: an accepted class that is nested in none, with the
        data of the classes inside it, the aliases of all their nodes, and the comments on them.

        Of classes of one name the one with the smallest unit id holds the nested ones; each of them has a file.
        """
        # Spark takes a table of files for as small as what it was made of, and would send it to the driver: merge joins only
        there = self.heads.filter("error is null")
        found = there.select("unit_id", "name")
        once = found.groupBy("name").agg(F.min("unit_id").alias("unit_id"))
        tops = naming.outermost(once)
        placed = once.join(tops.hint("merge"), "name").join(once.select(F.col("name").alias("top"), F.col("unit_id").alias("file")).hint("merge"), "top")
        # an outermost class that is there more than once prints each time
        more = found.join(tops.filter("name = top").hint("merge"), "name").select("name", "unit_id", F.col("unit_id").alias("file"))
        placed = placed.select("name", "unit_id", "file").unionByName(more).distinct()
        data = there.select("unit_id", "name", "data").join(placed.hint("merge"), ["unit_id", "name"])
        item = F.struct((F.col("unit_id") != F.col("file")).alias("inner"), "name", "data")
        files = data.groupBy(F.col("file").alias("unit_id")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["data"]).alias("files"))
        owner = F.substring_index("node", "#", 1)
        entry = F.struct(F.concat_ws(" ", "kind", "node").alias("key"), F.col("alias").alias("value"))
        given = self.rename_map.filter("kind in ('c', 'f', 'm')").withColumn("name", owner).join(placed.hint("merge"), "name")
        aliases = given.groupBy(F.col("file").alias("unit_id")).agg(F.map_from_entries(F.collect_set(entry)).alias("aliases"))
        told = self.comments.filter(F.lit(D.COMMENT_LEVELS.index(self.options.comment_level.lower()) >= 1)).filter("kind = 'c'")
        told = told.groupBy(F.col("node").alias("name")).agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("t")).join(placed.hint("merge"), "name")
        notes = told.groupBy(F.col("file").alias("unit_id")).agg(F.map_from_entries(F.collect_set(F.struct(F.col("name").alias("key"), F.col("t.text").alias("value")))).alias("notes"))
        return files.join(aliases.hint("merge"), "unit_id", "left").join(notes.hint("merge"), "unit_id", "left")

    @property
    def sources(self) -> DataFrame:
        """unit_id, class_name, package, file_name, text, error: a source file for each class that is nested in none, with
        its nested classes inside, aliases and comments applied; and the units that do not parse."""
        printed = tables.file_sources(self.files, self.options.style)
        bad = self.heads.filter("error is not null").select("unit_id", "error")
        return printed.unionByName(bad, allowMissingColumns=True)

    @property
    def errors(self) -> DataFrame:
        """unit_id, stage, message of what could not be read; messages begin with the origin."""
        origins = self.units.select("unit_id", "origin")
        dex = self.dex.filter("error is not null").select("unit_id", F.lit("parse").alias("stage"), F.col("error").alias("message"))
        bad = tables.errors(self.parsed).unionByName(dex).join(origins, "unit_id").select("unit_id", "stage", F.concat_ws(": ", "origin", "message").alias("message"))
        archives = tables.explode_archives(self.inputs, self.options.entry_limit).filter("error is not null")
        return bad.unionByName(archives.select("unit_id", F.lit("archive").alias("stage"), F.concat_ws(": ", "origin", "error").alias("message")))

    # ---- renames and comments

    def add_rename(self, kind: str, node: str, alias: str) -> Engine:
        """A node's name in what is printed; kind is one of names.KIND_CODES or its letter. Of a node's renames the first counts."""
        self._renames.append((N.KIND_CODES.get(kind, kind), node, alias, len(self._renames)))
        return self

    def add_comment(self, node: str, text: str, kind: str = "c", line: int = -1) -> Engine:
        self._comments.append((N.KIND_CODES.get(kind, kind), node, line, text, len(self._comments)))
        return self

    def load_map(self, path: str) -> Engine:
        """Renames and comments of a map; they come before those that were added, and before made aliases."""
        self._loaded.append(R.read_map(self.spark, path))
        return self

    def add_map(self, renames: DataFrame, comments: DataFrame | None = None) -> Engine:
        """load_map() of tables: renames (kind, node, slot, alias, ord), comments (kind, node, line, text, ord)."""
        self._loaded.append((renames, comments if comments is not None else self.spark.createDataFrame([], COMMENT)))
        return self

    def save_map(self, path: str) -> bool:
        return R.write_map(self.rename_map, path, self.comments)

    @property
    def rename_map(self) -> DataFrame:
        """kind, node, alias, ord of all renames: loaded, added, then made ones; of a node the first counts."""
        out = self.spark.createDataFrame(self._renames, RENAME)
        for loaded, _ in reversed(self._loaded):
            out = naming.merge_renames(loaded.filter("slot is null").select("kind", "node", "alias", F.col("ord").cast("long")), out)
        if self.options.rename_shorter_than:
            out = naming.merge_renames(out, self.renames().select("kind", "node", "alias", F.col("number").alias("ord")))
        return naming.first_wins(out)

    @property
    def comments(self) -> DataFrame:
        """kind, node, line, text, ord of all comments, loaded ones first."""
        out = self.spark.createDataFrame([(*x[:4], (len(self._loaded) << 32) + x[4]) for x in self._comments], COMMENT)
        for k, (_, loaded) in enumerate(self._loaded):
            out = out.unionByName(loaded.select("kind", "node", "line", "text", (F.col("ord") + F.lit(k << 32)).alias("ord")))
        return out

    def renames(self) -> DataFrame:
        """kind, node, alias, number of the classes and members whose names are to go, numbered per kind in the order of
        classes and members."""
        least, listed = self.options.rename_shorter_than, self.options.whitelist
        rows = self.fields.select(F.lit("f").alias("kind"), F.col("id").alias("node"), "class_name", "idx", "name", F.lit(False).alias("several"), F.lit(0).alias("access"))
        many = self.methods.groupBy("class_name", "name").agg(F.count(F.lit(1)).alias("n"))
        methods = self.methods.join(many, ["class_name", "name"]).select(F.lit("m").alias("kind"), F.col("id").alias("node"), "class_name", "idx", "name", (F.col("n") > 1).alias("several"), F.lit(0).alias("access"))
        simple = F.substring_index(N.simple_name(F.col("name")), "$", -1)
        classes = tables.classes(self.parsed).select(F.lit("c").alias("kind"), F.col("name").alias("node"), F.col("name").alias("class_name"), F.lit(-1).alias("idx"), simple.alias("name"), F.lit(False).alias("several"), "access")
        asked = N.should_rename(F.col("name"), least, False)
        if listed:
            hit = N.whitelisted(F.col("class_name"), listed)
            asked = asked | (hit & N.should_rename(F.col("name"), least, True)) if self.options.force_whitelist else asked & ~hit
        if self.options.skip_packages:
            asked = asked & ~N.skip_package(N.package_of(F.col("class_name")), self.options.skip_packages)
        numbered = naming.number_by_kind(rows.unionByName(methods).unionByName(classes).filter(asked), "kind", ["class_name", "idx", "node"])
        number, name = F.col("number").cast("int"), F.col("name")
        prefix = F.when(D.has(F.col("access"), "enum"), "Enum").when(D.has(F.col("access"), "interface"), "Interface").when(D.has(F.col("access"), "abstract"), "Abstract").otherwise("")
        alias = F.when(F.col("kind") == "f", N.field_alias(number, name)).when(F.col("kind") == "m", N.method_alias(number, name, F.col("several"))).otherwise(N.class_alias(number, name, prefix))
        return numbered.select("kind", "node", alias.alias("alias"), "number").orderBy("kind", "number")

    # ---- sinks

    def to_json(self) -> DataFrame:
        """unit_id, json: name, package, file name, fields, methods and source of each class."""
        from .functions.descriptors import readable

        f = F.transform("fields", lambda x: F.concat(x["name"], F.lit(": "), readable(x["descriptor"])))
        m = F.transform("methods", lambda x: F.concat(x["name"], x["descriptor"]))
        rows = self.parsed.filter("error is null").select("unit_id", F.translate("name", "/$", "..").alias("name"), f.alias("fields"), m.alias("methods"))
        both = rows.join(self.sources.filter("error is null").drop("error", "class_name"), "unit_id").join(self.units.select("unit_id", "origin"), "unit_id")
        whole = F.struct("name", F.translate("package", "/", ".").alias("package"), "origin", F.col("file_name").alias("fileName"), "fields", "methods", F.col("text").alias("source"))
        return both.select("unit_id", F.to_json(whole).alias("json"))

    def save(self, path: str) -> DataFrame:
        """Write every source to `<path>/<package>/<Outer>.java`; class_name, path of the files, by class.

        `path` must be one that all executors see. Progress is told behind the writing, class by class.
        """
        from .plans.loops import cut

        written = cut(tables.save_sources(self.sources, path))
        total = written.count()
        for done, row in enumerate(written.orderBy("class_name").toLocalIterator(), 1):
            self._progress(done, total, _dotted(row["class_name"]))
        self._log(f"{total} files written")
        return written.orderBy("class_name")


def _dotted(name: str) -> str:
    return name.replace("/", ".").replace("$", ".")


def percent(done: int, total: int) -> int:
    """How much of the work is done, from 0 to 100; of no work all."""
    return 100 * done // total if total else 100
