"""Tables of the attributes that the table of classes leaves out: one Arrow kernel, then an explode each."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import classfile
from ..kernels.binary import FormatError
from .tables import arrow_schema

ENTRY = "struct<tag:string,type:string,off:int>"
SHAPE = {
    "frames": f"array<struct<method_idx:int,ord:int,off:int,locals:array<{ENTRY}>,stack:array<{ENTRY}>>>",
    "annotations": "array<struct<place:string,idx:int,visible:boolean,ord:int,type:string,values:string>>",
    "param_annotations": "array<struct<method_idx:int,param:int,visible:boolean,type:string,values:string>>",
    "defaults": "array<struct<method_idx:int,value:string>>",
    "inner_classes": "array<struct<ord:int,inner:string,outer:string,name:string,access:int>>",
    "bootstrap": "array<struct<ord:int,method:int,args:array<int>>>",
    "components": "array<struct<ord:int,name:string,descriptor:string,signature:string>>",
    "method_params": "array<struct<method_idx:int,ord:int,name:string,access:int>>",
    "variable_types": "array<struct<method_idx:int,start_pc:int,length:int,name:string,type:string,slot:int>>",
    "marks": "array<struct<place:string,idx:int,deprecated:boolean,synthetic:boolean,signature:string>>",
    "nest_members": "array<string>",
    "permitted": "array<string>",
    "nest_host": "string",
    "enclosing": "struct<class:string,method:string,descriptor:string>",
}
VISIBILITY = (("RuntimeVisible", True), ("RuntimeInvisible", False))


def _value(v: dict):
    """An annotation's value as JSON takes it: its tag, and what it holds."""
    x = v["value"]
    if v["tag"] == "[":
        x = [_value(i) for i in x]
    elif v["tag"] == "@":
        x = _annotation(x)
    return {"tag": v["tag"], **({"type": v["type"]} if "type" in v else {}), "value": x}


def _annotation(a: dict) -> dict:
    return {"type": a["type"], "values": {k: _value(v) for k, v in a["values"].items()}}


def _row(unit: int, c: classfile.ClassFile) -> dict:
    out: dict = {"unit_id": unit, **{k: [] for k, v in SHAPE.items() if v.startswith("array")}}
    text = lambda a: {"type": a["type"], "values": json.dumps(_annotation(a)["values"], sort_keys=True)}
    for place, members in (("class", [c]), ("field", c.fields), ("method", c.methods)):
        for idx, m in enumerate(members):
            a = m.attrs
            for stem, visible in VISIBILITY:
                out["annotations"] += [{"place": place, "idx": idx, "visible": visible, "ord": n, **text(x)} for n, x in enumerate(a.get(f"{stem}Annotations", ()))]
                out["param_annotations"] += [{"method_idx": idx, "param": n, "visible": visible, **text(x)} for n, each in enumerate(a.get(f"{stem}ParameterAnnotations", ())) for x in each]
            if "AnnotationDefault" in a:
                out["defaults"].append({"method_idx": idx, "value": json.dumps(_value(a["AnnotationDefault"]), sort_keys=True)})
            out["method_params"] += [{"method_idx": idx, "ord": n, **x} for n, x in enumerate(a.get("MethodParameters", ()))]
            if place != "class":
                out["marks"].append({"place": place, "idx": idx, "deprecated": "Deprecated" in a, "synthetic": "Synthetic" in a, "signature": a.get("Signature")})
            inner = a["Code"]["attrs"] if "Code" in a else {}
            out["frames"] += [{"method_idx": idx, "ord": n, **x} for n, x in enumerate(inner.get("StackMapTable", ()))]
            out["variable_types"] += [{"method_idx": idx, **x} for x in inner.get("LocalVariableTypeTable", ())]
    a = c.attrs
    out["inner_classes"] = [{"ord": n, **x} for n, x in enumerate(a.get("InnerClasses", ()))]
    out["bootstrap"] = [{"ord": n, **x} for n, x in enumerate(a.get("BootstrapMethods", ()))]
    out["components"] = [{"ord": n, "name": x["name"], "descriptor": x["type"], "signature": x["attrs"].get("Signature")} for n, x in enumerate(a.get("Record", ()))]
    out["nest_members"], out["permitted"], out["nest_host"] = a.get("NestMembers", []), a.get("PermittedSubclasses", []), a.get("NestHost")
    if "EnclosingMethod" in a:
        method = a["EnclosingMethod"]["method"] or [None, None]
        out["enclosing"] = {"class": a["EnclosingMethod"]["class"], "method": method[0], "descriptor": method[1]}
    return out


def parse_attributes(units: DataFrame) -> DataFrame:
    """unit_id and a column for each of SHAPE, of every class unit that parses."""
    ddl = ", ".join(["unit_id long", *(f"{k} {v}" for k, v in SHAPE.items())])
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for unit, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    try:
                        rows.append(_row(unit, classfile.parse(data or b"")))
                    except FormatError:
                        continue  # the table of errors has it
                yield pa.RecordBatch.from_pylist(rows, schema)

    return units.filter("kind = 'class'").select("unit_id", "data").mapInArrow(run, ddl)


def bootstraps(units: DataFrame) -> DataFrame:
    """unit_id, ord, kind (the number of the method handle's kind, null if its slot holds no handle), args (idx, tag, text of
    each constant, as text if it has one) of the bootstrap methods, in one pass: their pool is in the same file."""
    ddl = "unit_id long, ord int, kind int, args array<struct<idx:int,tag:int,text:string>>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for unit, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    c = classfile.parse(data.as_py() or b"")
                except FormatError:
                    continue  # the table of errors has it
                found = c.attrs.get("BootstrapMethods", ())
                pool = {i: x for i, x in enumerate(c.pool.at) if x} if found else {}
                texts = {i: text for i, _, _, _, _, text in classfile.resolve(pool)}
                for n, x in enumerate(found):
                    handle = pool.get(x["method"])
                    args = [(i, pool[i]) if i in pool else (i, None) for i in x["args"]]
                    values = [{"idx": i, "tag": a and a.tag, "text": texts.get(i) if a is None or a.value is None else str(a.value)} for i, a in args]
                    rows.append({"unit_id": unit, "ord": n, "kind": handle.ref1 if handle and handle.tag == classfile.HANDLE else None, "args": values})
                if len(rows) >= 1024:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    return units.filter("kind = 'class'").select("unit_id", "data").mapInArrow(run, ddl)


def table(parsed: DataFrame, what: str) -> DataFrame:
    """The rows of one of SHAPE: unit_id, then its fields (`name` and its place `ord` for lists of names)."""
    if SHAPE[what] == "array<string>":
        return parsed.select("unit_id", F.posexplode(what).alias("ord", "name"))
    if SHAPE[what].startswith("array"):
        return parsed.select("unit_id", F.inline(what))
    one = parsed.filter(F.col(what).isNotNull())
    return one.select("unit_id", f"{what}.*") if SHAPE[what].startswith("struct") else one.select("unit_id", F.col(what).alias("name"))
