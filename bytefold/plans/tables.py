"""Normalized tables of code units: one Arrow kernel per kind of file, then explodes.

units: unit_id, origin, name, kind, data. A unit that does not parse gives a row of errors and never fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import archive, classfile, insn
from ..kernels.binary import FormatError
from ..kernels.decompile import Style, body_lines, class_source, imports, method_source

HANDLER = "struct<ord:int,start_pc:int,end_pc:int,handler_pc:int,catch_type:string>"
INSN = "struct<off:int,opcode:int,mnemonic:string,sem:string,len:int,wide:boolean,local:int,value:string,ref_class:string,ref_name:string,ref_desc:string,targets:array<int>>"
FIELD = "struct<idx:int,access:int,name:string,descriptor:string,const_kind:string,const_text:string>"
METHOD = f"struct<idx:int,access:int,name:string,descriptor:string,max_stack:int,max_locals:int,code:binary,throws:array<string>,handlers:array<{HANDLER}>,lines:array<struct<start_pc:int,line:int>>,variables:array<struct<start_pc:int,length:int,name:string,type:string,slot:int>>,insns:array<{INSN}>,listing:string,error:string>"
CONST = "struct<idx:int,tag:int,text:string,ref1:int,ref2:int>"
CLASS = f"unit_id long, name string, major int, minor int, access int, super string, interfaces array<string>, signature string, source_file string, fields array<{FIELD}>, methods array<{METHOD}>, const_pool array<{CONST}>, error string"


def arrow_schema(spark_ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(spark_ddl))


def insn_rows(code: bytes, pool: classfile.Pool) -> list[dict]:
    out = []
    for i in insn.decode(code, pool):
        ref = i.ref or ()
        owner, name, desc = ref if len(ref) == 3 else (ref[0] if ref else None, None, None)
        out.append({"off": i.off, "opcode": i.op.code, "mnemonic": i.op.name, "sem": i.op.sem, "len": i.size, "wide": i.wide, "local": i.local, "value": None if i.value is None else str(i.value), "ref_class": owner, "ref_name": name, "ref_desc": desc, "targets": i.targets})
    return out


def _method(idx: int, m: classfile.Member, pool: classfile.Pool) -> dict:
    body = m.attrs.get("Code")
    row = {"idx": idx, "access": m.access, "name": m.name, "descriptor": m.descriptor, "throws": m.attrs.get("Exceptions", [])}
    if body:
        row |= {"max_stack": body["max_stack"], "max_locals": body["max_locals"], "code": body["code"], "handlers": [{"ord": k, **h} for k, h in enumerate(body["handlers"])], "lines": body["attrs"].get("LineNumberTable", []), "variables": body["attrs"].get("LocalVariableTable", []), "listing": insn.listing(body, pool)}
        try:
            row["insns"] = insn_rows(body["code"], pool)
        except FormatError as e:
            row["error"] = str(e)
    return row


def class_row(unit_id: int, data: bytes) -> dict:
    try:
        c = classfile.parse(data)
    except FormatError as e:
        return {"unit_id": unit_id, "error": str(e)}
    constants = [{"idx": i, "tag": x.tag, "text": None if x.value is None else str(x.value), "ref1": x.ref1, "ref2": x.ref2} for i, x in enumerate(c.pool.at) if x]
    fields = []
    for i, f in enumerate(c.fields):
        kind, value = f.attrs.get("ConstantValue", (None, None))
        fields.append({"idx": i, "access": f.access, "name": f.name, "descriptor": f.descriptor, "const_kind": kind, "const_text": None if value is None else str(value)})
    return {"unit_id": unit_id, "name": c.name, "major": c.major, "minor": c.minor, "access": c.access, "super": c.super_name, "interfaces": c.interfaces, "signature": c.attrs.get("Signature"), "source_file": c.attrs.get("SourceFile"), "fields": fields, "methods": [_method(i, m, c.pool) for i, m in enumerate(c.methods)], "const_pool": constants}


def parse_classes(units: DataFrame) -> DataFrame:
    """A row per class unit, its members nested; `error` says why one did not parse."""

    schema = arrow_schema(CLASS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [class_row(u, d or b"") for u, d in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return units.filter("kind = 'class'").select("unit_id", "data").mapInArrow(run, CLASS)


def classes(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is null").drop("fields", "methods", "const_pool", "error")


def errors(parsed: DataFrame) -> DataFrame:
    bad = parsed.filter("error is not null").select("unit_id", F.lit("parse").alias("stage"), F.col("error").alias("message"))
    each = parsed.select("unit_id", F.explode("methods").alias("m")).filter("m.error is not null")
    return bad.unionByName(each.select("unit_id", F.lit("decode").alias("stage"), F.concat_ws(": ", "m.name", "m.error").alias("message")))


def fields(parsed: DataFrame) -> DataFrame:
    return parsed.select("unit_id", F.inline("fields"))


def methods(parsed: DataFrame) -> DataFrame:
    return parsed.select("unit_id", F.inline("methods")).drop("handlers", "lines", "variables", "insns", "listing")


def const_pool(parsed: DataFrame) -> DataFrame:
    return parsed.select("unit_id", F.inline("const_pool"))


RESOLVED = "unit_id long, idx int, tag int, owner string, member string, descriptor string, text string"


def _resolved_rows(pools: Iterator[tuple[int, dict[int, classfile.Constant]]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for unit, pool in pools:
        rows += [(unit, *x) for x in classfile.resolve(pool)]
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def resolved_pool(units: DataFrame) -> DataFrame:
    """resolve_pool() of class units in one pass: a pool is whole in its file, so nothing is joined or moved."""
    schema = arrow_schema(RESOLVED)

    def pools(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        for batch in batches:
            for unit, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    c = classfile.parse(data.as_py() or b"")
                except FormatError:
                    continue  # the table of errors has it
                yield unit, {i: x for i, x in enumerate(c.pool.at) if x}

    return units.filter("kind = 'class'").select("unit_id", "data").mapInArrow(lambda batches: _resolved_rows(pools(batches), schema), RESOLVED)


def resolve_pool(pool: DataFrame) -> DataFrame:
    """const_pool rows with what they refer to: unit_id, idx, tag, owner, member, descriptor, text.

    Classes and strings find their text; fields, methods and call sites their owner, name and descriptor. A unit's rows
    come together in one, of at most 65,535 constants; units share nothing.
    """
    schema = arrow_schema(RESOLVED)

    def pools(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        for batch in batches:
            for unit, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield unit, {x["idx"]: classfile.Constant(x["tag"], x["text"], x["ref1"], x["ref2"]) for x in rows.as_py()}

    whole = pool.groupBy("unit_id").agg(F.collect_list(F.struct("idx", "tag", "text", "ref1", "ref2")).alias("pool"))
    return whole.mapInArrow(lambda batches: _resolved_rows(pools(batches), schema), RESOLVED)


def _of_methods(parsed: DataFrame, what: str) -> DataFrame:
    return parsed.select("unit_id", F.explode("methods").alias("m")).select("unit_id", F.col("m.idx").alias("method_idx"), F.inline(f"m.{what}"))


def handlers(parsed: DataFrame) -> DataFrame:
    return _of_methods(parsed, "handlers")


def line_numbers(parsed: DataFrame) -> DataFrame:
    return _of_methods(parsed, "lines")


def local_variables(parsed: DataFrame) -> DataFrame:
    return _of_methods(parsed, "variables")


def insns(parsed: DataFrame) -> DataFrame:
    return _of_methods(parsed, "insns")


def listings(parsed: DataFrame) -> DataFrame:
    return parsed.select("unit_id", F.explode("methods").alias("m")).select("unit_id", F.col("m.idx").alias("method_idx"), F.col("m.name").alias("name"), F.col("m.listing").alias("listing"))


def explode_archives(units: DataFrame, limit: int = archive.LIMIT) -> DataFrame:
    """unit_id, origin, name, kind, data, entry_ord, error of the `.class` and `.dex` entries of archive units.

    An archive is not looked into twice; the first bad entry ends its archive with an error row, and the entries before
    stay. Of entries with one name all read as the first.
    """
    ddl = "unit_id long, origin string, name string, kind string, data binary, entry_ord int, error string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, origin, data in zip(*(batch.column(i) for i in range(3))):
                unit, origin, data, rows = unit.as_py(), origin.as_py(), data.as_py() or b"", []
                try:
                    listed = archive.entries(data)
                    first = {x.name: x for x in reversed(listed)}
                    for x in listed:
                        if not x.is_dir and x.name.endswith((".class", ".dex")):
                            body = archive.read(data, first[x.name], limit)
                            rows.append({"unit_id": unit, "origin": f"{origin}!{x.name}", "name": x.name, "kind": x.name.rpartition(".")[2], "data": body, "entry_ord": x.ord})
                            if len(rows) == 64:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows = []
                except FormatError as e:
                    rows.append({"unit_id": unit, "origin": origin, "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return units.filter("kind = 'archive'").select("unit_id", "origin", "data").mapInArrow(run, ddl)


def method_sources(units: DataFrame, style: Style = Style()) -> DataFrame:
    """unit_id, method_idx, name, descriptor, text: the source of each method by itself."""
    ddl = "unit_id long, method_idx int, name string, descriptor string, text string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    c = classfile.parse(data.as_py() or b"")
                except FormatError:
                    continue  # the table of errors has it
                rows = [{"unit_id": unit, "method_idx": k, "name": m.name, "descriptor": m.descriptor, "text": "\n".join(method_source(c, m, style))} for k, m in enumerate(c.methods)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return units.filter("kind = 'class'").select("unit_id", "data").mapInArrow(run, ddl)


def pass_reports(units: DataFrame) -> DataFrame:
    """unit_id, method_idx, returns_stripped, increments_folded, temps_inlined, labels of every method with code that can be
    read."""
    ddl = "unit_id long, method_idx int, returns_stripped int, increments_folded int, temps_inlined int, labels int"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for unit, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    c = classfile.parse(data.as_py() or b"")
                except FormatError:
                    continue  # the table of errors has it
                for k, m in enumerate(c.methods):
                    try:
                        rows += [{"unit_id": unit, "method_idx": k, **vars(body_lines(c, m, Style())[2])}] if "Code" in m.attrs else []
                    except (FormatError, RecursionError):
                        continue
            yield pa.RecordBatch.from_pylist(rows, schema)

    return units.filter("kind = 'class'").select("unit_id", "data").mapInArrow(run, ddl)


def class_texts(units: DataFrame) -> DataFrame:
    """unit_id, file_name, imports, listing (its methods' listings, one below the other) of every class that parses."""
    ddl = "unit_id long, file_name string, imports array<string>, listing string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for unit, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    c = classfile.parse(data.as_py() or b"")
                except FormatError:
                    continue  # the table of errors has it
                parts = [f"{m.name}{m.descriptor}\n{insn.listing(m.attrs['Code'], c.pool)}" for m in c.methods if "Code" in m.attrs]
                rows.append({"unit_id": unit, "file_name": f"{c.name.partition('$')[0]}.java", "imports": imports(c), "listing": "\n\n".join(parts)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return units.filter("kind = 'class'").select("unit_id", "data").mapInArrow(run, ddl)


def heads(units: DataFrame) -> DataFrame:
    """unit_id, name, data, error of every class unit: its file, with the name of its class or why it does not parse."""
    ddl = "unit_id long, name string, data binary, error string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, names, errors = batch.slice(at, 256), [], []
                for data in part.column(1):
                    try:
                        name, error = classfile.parse(data.as_py() or b"").name, None
                    except FormatError as e:
                        name, error = None, str(e)
                    names.append(name)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), part.column(1).cast(pa.binary()), pa.array(errors, pa.string())], schema=schema)

    return units.filter("kind = 'class'").select("unit_id", "data").mapInArrow(run, ddl)


FILE = "unit_id long, class_name string, package string, file_name string, text string, error string"


def sources(units: DataFrame, style: Style = Style()) -> DataFrame:
    """unit_id, class_name, package, file_name, text, error: the decompiled source of every class unit, each by itself."""
    one = units.filter("kind = 'class'").select("unit_id", F.array(F.col("data")).alias("files"))
    no = F.create_map().cast("map<string,string>")
    return file_sources(one.select("unit_id", "files", no.alias("aliases"), F.create_map().cast("map<string,array<string>>").alias("notes")), style)


def file_sources(files: DataFrame, style: Style = Style()) -> DataFrame:
    """sources() of rows (unit_id, files: the class files of one source file, its outermost first; aliases: `kind node` ->
    name; notes: class -> comments above it). A nested class that does not parse is left out."""
    schema = arrow_schema(FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for unit, files, aliases, notes in zip(*(batch.column(c) for c in range(4))):
                try:
                    files = files.as_py()
                    parsed = [classfile.parse(files[0] or b"")]
                    for data in files[1:]:
                        try:
                            parsed.append(classfile.parse(data or b""))
                        except FormatError:
                            continue
                    c, given = parsed[0], dict(aliases.as_py() or ())
                    package, _, name = c.name.rpartition("/")
                    name = given.get(f"c {c.name}") or name.partition("$")[0]
                    rows.append({"unit_id": unit.as_py(), "class_name": c.name, "package": package, "file_name": f"{package}/{name}.java".lstrip("/"), "text": class_source(c, style, parsed[1:], given, dict(notes.as_py() or ()))})
                except FormatError as e:
                    rows.append({"unit_id": unit.as_py(), "error": str(e)})
                if len(rows) == 64:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("unit_id", "files", "aliases", "notes").mapInArrow(run, FILE)


def parse_dex(units: DataFrame) -> DataFrame:
    """A row per class of every dex unit: unit_id, name, access, super, source, interfaces, members, listing, error."""
    member = "struct<kind:string,index:int,access:int,name:string,descriptor:string>"
    ddl = f"unit_id long, name string, access int, super string, source string, interfaces array<string>, members array<{member}>, listing string, error string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..kernels import dexfile

        for batch in batches:
            for unit, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    dex = dexfile.DexFile(data or b"")
                    for c in dex.classes:
                        members = [{"kind": m.kind, "index": m.index, "access": m.access, "name": m.name, "descriptor": m.descriptor} for m in c.members]
                        rows.append({"unit_id": unit, "name": c.name, "access": c.access, "super": c.super_name, "source": c.source, "interfaces": c.interfaces, "members": members, "listing": dexfile.listing(dex, c)})
                except FormatError as e:
                    rows.append({"unit_id": unit, "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return units.filter("kind = 'dex'").select("unit_id", "data").mapInArrow(run, ddl)


def _of_dex(units: DataFrame, ddl: str, rows_of) -> DataFrame:
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..kernels import dexfile

        for batch in batches:
            for unit, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    dex = dexfile.DexFile(data.as_py() or b"")
                except FormatError:
                    continue  # the table of errors has it
                rows = [{"unit_id": unit, **r} for r in rows_of(dex)]
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 4096], schema)

    return units.filter("kind = 'dex'").select("unit_id", "data").mapInArrow(run, ddl)


def dex_ids(units: DataFrame) -> DataFrame:
    """unit_id, kind (string, type, proto, field, method), idx, owner, name, descriptor of the id tables of dex units."""
    names = ("kind", "idx", "owner", "name", "descriptor")
    return _of_dex(units, "unit_id long, kind string, idx int, owner string, name string, descriptor string", lambda dex: [dict(zip(names, r)) for r in dex.id_rows()])


def _dex_code(rows_of):
    def each(dex) -> list[dict]:
        out = []
        for c in dex.classes:
            for m in c.members:
                if m.code_off:
                    try:
                        found = rows_of(dex, m.code_off)
                    except FormatError:
                        continue  # its listing says why
                    out += [{"class_name": c.name, "method": f"{m.name}{m.descriptor}", **r} for r in found]
        return out

    return each


def dex_insns(units: DataFrame) -> DataFrame:
    """unit_id, class_name, method, off (16-bit units), opcode, name, text of every instruction of dex units."""
    return _of_dex(units, "unit_id long, class_name string, method string, off int, opcode int, name string, text string", _dex_code(lambda dex, at: dex.code(at)))


def dex_tries(units: DataFrame) -> DataFrame:
    """unit_id, class_name, method, start, end, handler, type of the try items of dex units."""
    return _of_dex(units, "unit_id long, class_name string, method string, start int, end int, handler int, type string", _dex_code(lambda dex, at: dex.tries(at)))


def dex_methods(units: DataFrame) -> DataFrame:
    """unit_id, class_name, ord, method, listing: each method of a dex class by itself, in declaration order."""

    def each(dex) -> list[dict]:
        from ..kernels.dexfile import method_listing

        return [{"class_name": c.name, "ord": k, "method": f"{m.name}{m.descriptor}", "listing": "\n".join(method_listing(dex, m))} for c in dex.classes for k, m in enumerate([m for m in c.members if m.kind.endswith("method")])]

    return _of_dex(units, "unit_id long, class_name string, ord int, method string, listing string", each)


def save_sources(found: DataFrame, path: str) -> DataFrame:
    """Write each source to `<path>/<its file name>`, over what is there; the paths written, by class.

    Tasks write their own rows through the file system that `path` names, each file under a name of its own first, so that
    a task that is run again does no harm. `path` must be one that all executors see.
    """
    ddl = "class_name string, path string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
        for batch in batches:
            rows = []
            for name, file_name, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                goal = f"{root}/{file_name}"
                store.create_dir(goal.rpartition("/")[0], recursive=True)
                own = f"{goal}.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(text.encode("utf-8", "replace"))
                store.move(own, goal)
                rows.append({"class_name": name, "path": goal})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return found.filter("error is null").select("class_name", "file_name", "text").mapInArrow(run, ddl)


# Constant kinds by tag, and how their references are written.
POOL_KINDS = {1: ("Utf8", "text"), 3: ("Integer", "value"), 4: ("Float", "value"), 5: ("Long", "value"), 6: ("Double", "value"), 7: ("Class", "one"), 8: ("String", "one"), 9: ("Fieldref", "dot"), 10: ("Methodref", "dot"), 11: ("InterfaceMethodref", "dot"), 12: ("NameAndType", "dot"), 15: ("MethodHandle", "handle"), 16: ("MethodType", "one"), 17: ("Dynamic", "two"), 18: ("InvokeDynamic", "two"), 19: ("Module", "one"), 20: ("Package", "one")}


def pool_lines(pool: DataFrame) -> DataFrame:
    """unit_id, idx, line of const_pool rows: the slot, the kind, and its value or the slots it refers to."""
    a, b = F.concat(F.lit("#"), F.col("ref1").cast("string")), F.concat(F.lit("#"), F.col("ref2").cast("string"))
    shapes = {"text": F.to_json(F.struct(F.col("text").alias("v"))), "value": F.col("text"), "one": a, "dot": F.concat(a, F.lit("."), b), "two": F.concat_ws(" ", a, b), "handle": F.concat_ws(" ", F.col("ref1").cast("string"), b)}
    shapes["text"] = F.substring(shapes["text"], F.lit(6), F.length(shapes["text"]) - 6)
    body = F.lit(None).cast("string")
    for tag, (kind, shape) in POOL_KINDS.items():
        body = F.when(F.col("tag") == tag, F.concat_ws(" ", F.lit(kind), shapes[shape])).otherwise(body)
    return pool.select("unit_id", "idx", F.concat(F.lit("#"), F.col("idx").cast("string"), F.lit(": "), body).alias("line"))
