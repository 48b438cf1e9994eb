"""The instruction sets as small tables, to join with instruction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import dexfile, opcodes

# Semantic classes by what they say about control flow and constants.
GOES_AWAY = ("goto", "jsr", "ret", "throw", "return")
MAY_JUMP = ("if", "if_icmp", "if_acmp", "if_null", "switch")
CONSTANTS = ("const_null", "const_int", "const_long", "const_float", "const_double", "ldc")
FIELDS = ("get_static", "put_static", "get_field", "put_field")


def sem_flags(sem: Column) -> dict[str, Column]:
    """Booleans by name over a semantic class."""
    return {"unconditional": sem.isin(*GOES_AWAY), "conditional": sem.isin(*MAY_JUMP), "const_load": sem.isin(*CONSTANTS), "field_access": sem.isin(*FIELDS)}


def jvm_opcodes(spark: SparkSession) -> DataFrame:
    """opcode, mnemonic, layout, operand_bytes (null where it varies), sem and its flags; 202 rows."""
    rows = [(o.code, o.name, o.layout, opcodes.LENGTHS[o.layout], o.sem) for o in opcodes.OPS]
    made = spark.createDataFrame(rows, "opcode int, mnemonic string, layout string, operand_bytes int, sem string")
    return made.select("*", *[c.alias(n) for n, c in sem_flags(F.col("sem")).items()])


def registers(form: str) -> int | None:
    """How many registers a format of dex instructions names: its second character, unless their number varies."""
    return None if form[1] in "r5" else int(form[1])


def dex_opcodes(spark: SparkSession) -> DataFrame:
    """opcode, mnemonic (null where unused), format, units (16-bit), registers (null where variable), index_kind; 256 rows."""
    rows = [(k, name or None, form, dexfile.UNITS[form], registers(form), index) for k, (name, form, index) in enumerate(dexfile.OPCODES)]
    return spark.createDataFrame(rows, "opcode int, mnemonic string, format string, units int, registers int, index_kind string")
