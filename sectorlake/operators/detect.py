"""File types by content: an ordered list of rules, the first that holds wins.

``register`` adds rules; the built-in ones stand in the order IFF, module, bank, icon, archive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sectorlake.functions import binary as b


@dataclass
class Handler:
    """types: id -> (shown name, actions); rule: content -> type id or null; inspect: content -> text or null."""

    types: dict[str, tuple[str, list[str]]]
    rule: Callable[[Column], Column]
    inspect: Callable[[Column], Column] | None = None
    numbers: dict[str, int] = field(default_factory=dict)


REGISTRY: list[Handler] = []


def register(handler: Handler) -> Handler:
    """Types are numbered from 2 in the order they are registered."""
    start = 2 + sum(len(h.types) for h in REGISTRY)
    handler.numbers = {name: start + k for k, name in enumerate(handler.types)}
    REGISTRY.append(handler)
    return handler


def _tag(data: Column, offset: int = 0, size: int = 4) -> Column:
    return b.latin1(data, offset, size)


def _iff(data: Column) -> Column:
    kind = _tag(data, 8)
    fits = (_tag(data) == "FORM") & (b.u32(data, 4) + 8 <= F.octet_length(data))
    return F.when(fits, F.when(kind == "ILBM", "ILBM").when(kind == "ANIM", "ANIM").otherwise("IFF"))


#: The tags of module files.
MODULE_TAGS = ["M.K.", "M!K!", "M&K!", "FLT4", "2CHN", "6CHN", "8CHN", "10CH", "12CH", "14CH", "16CH", "18CH", "20CH", "22CH", "24CH", "26CH", "28CH", "30CH", "32CH"]


def _module(data: Column) -> Column:
    return F.when((F.octet_length(data) > 1100) & _tag(data, 1080).isin(MODULE_TAGS), "MOD")


def _bank(data: Column) -> Column:
    tag = _tag(data)
    return F.when(tag == "AmBk", "AMBK").when(tag == "AmSp", "AMSP").when(tag == "AmIc", "AMIC")


def _icon(data: Column) -> Column:
    return F.when(b.u16(data, 0) == 0xE310, "ICON")


def _archive(data: Column) -> Column:
    return F.when(_tag(data) == "DMS!", "DMS")


def _inspect_iff(data: Column) -> Column:
    from sectorlake.operators.iff import inspect_udf

    return inspect_udf(data)


register(Handler({"IFF": ("IFF file", []), "ILBM": ("ILBM Image", ["show"]), "ANIM": ("IFF ILBM Animation", [])}, _iff, lambda d: F.when(_iff(d) == "ILBM", _inspect_iff(d))))
register(Handler({"MOD": ("Module", ["Play in Tracker"])}, _module))
register(Handler({"AMBK": ("Picture bank", []), "AMSP": ("Sprite bank", []), "AMIC": ("Icon bank", [])}, _bank, lambda d: F.when(_bank(d) == "AMSP", F.concat(F.lit("containing "), b.u16(d, 4).cast("string"), F.lit(" sprites")))))
register(Handler({"ICON": ("Icon file", ["show"])}, _icon, lambda d: F.when(_icon(d) == "ICON", F.lit("icon"))))
register(Handler({"DMS": ("Disk archive", ["unpack"])}, _archive))


def detect(data: Column, handlers: list[Handler] | None = None) -> Column:
    """The type id, or null."""
    return F.coalesce(*(h.rule(data) for h in (handlers or REGISTRY)), F.lit(None).cast("string"))


def inspect(data: Column, handlers: list[Handler] | None = None) -> Column:
    """What the winning handler says about the content, or null."""
    chosen = handlers or REGISTRY
    out = F.lit(None).cast("string")
    for h in reversed(chosen):
        out = F.when(h.rule(data).isNotNull(), h.inspect(data) if h.inspect else F.lit(None).cast("string")).otherwise(out)
    return out


def file_types(spark: SparkSession) -> DataFrame:
    """(number, type, name, actions, inspectable) of the registered types."""
    rows = [(h.numbers[t], t, name, actions, h.inspect is not None) for h in REGISTRY for t, (name, actions) in h.types.items()]
    return spark.createDataFrame(rows, "number int, type string, name string, actions array<string>, inspectable boolean")


def detect_files(files: DataFrame) -> DataFrame:
    """files: (disk_id, sector, content, ...).  (disk_id, sector, type, info)."""
    return files.select("disk_id", "sector", detect(F.col("content")).alias("type"), inspect(F.col("content")).alias("info"))
