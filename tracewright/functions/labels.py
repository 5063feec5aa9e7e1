"""Labels (//package:name) and patterns over them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z0-9_.-]+")


class LabelError(ValueError):
    """A label or pattern that cannot be read."""


def parse_label(text: str, current: str = "") -> tuple[str, str]:
    """(package, name): ``:x`` is relative to ``current``, ``//a/b`` means ``//a/b:b``."""
    if text.startswith(":"):
        package, name = current, text[1:]
    elif text.startswith("//"):
        package, colon, name = text[2:].partition(":")
        if not colon:
            name = package.rpartition("/")[2]
    else:
        raise LabelError(f"label {text!r} starts with neither // nor :")
    if not _NAME.fullmatch(name) or name == "...":
        raise LabelError(f"label {text!r} has no valid name")
    return package, name


def format_label(package: str, name: str) -> str:
    return f"//{package}:{name}"


def label_of(package: Column, name: Column) -> Column:
    return F.concat(F.lit("//"), package, F.lit(":"), name)


def package_of(label: Column) -> Column:
    return F.regexp_extract(label, r"^//([^:]*)", 1)


def name_of(label: Column) -> Column:
    """The part after the colon, or the last part of the package."""
    return F.when(label.contains(":"), F.regexp_extract(label, r":(.*)$", 1)).otherwise(F.regexp_extract(label, r"([^/]*)$", 1))


def shortened(label: Column) -> Column:
    """//a/b:b -> //a/b; others stay."""
    package, name = package_of(label), name_of(label)
    return F.when((package != "") & (F.regexp_extract(package, r"([^/]*)$", 1) == name), F.concat(F.lit("//"), package)).otherwise(label)


def is_test(label: Column) -> Column:
    return label.endswith("test")


@dataclass(frozen=True)
class Pattern:
    """A predicate over labels. An empty ``name`` takes any."""

    package: str
    name: str
    recursive: bool

    @classmethod
    def parse(cls, text: str, current: str = "") -> Pattern:
        """``//p/...`` and ``//p/...:t`` are recursive, ``//p:t`` is exact, ``//p`` means ``//p:p``; ``all`` and
        ``...`` as a name take any."""
        if text.startswith(":"):
            package, name = current, text[1:]
        elif text.startswith("//"):
            package, colon, name = text[2:].partition(":")
            if not colon and not (package == "..." or package.endswith("/...")):
                name = package.rpartition("/")[2]
        else:
            raise LabelError(f"pattern {text!r} starts with neither // nor :")
        recursive = package == "..." or package.endswith("/...")
        package = package.removesuffix("...").removesuffix("/") if recursive else package
        if "..." in package:
            raise LabelError(f"pattern {text!r} has more after ...")
        name = "" if name in ("all", "...") else name
        if name and not _NAME.fullmatch(name):
            raise LabelError(f"pattern {text!r} has no valid name")
        return cls(package, name, recursive)

    def matches(self, package: Column, name: Column) -> Column:
        inside = package == self.package
        if self.recursive:
            inside = F.lit(True) if not self.package else inside | package.startswith(f"{self.package}/")
        return inside & (name == self.name) if self.name else inside


def any_pattern(patterns: list[Pattern], package: Column, name: Column) -> Column:
    """Any of the patterns; without patterns everything."""
    return reduce(or_, (p.matches(package, name) for p in patterns)) if patterns else F.lit(True)


def completions(labels, typed: str, current: str = ""):
    """(package, name) rows -> suggestions (completion) for a typed prefix, sorted and distinct.

    Before the colon: child packages (with / where they have children, and /... then) and, once the package is whole,
    its labels. After the colon: labels of the package whose name starts so.
    """
    package, name = F.col("package"), F.col("name")
    if ":" in typed:
        prefix, _, start = typed.partition(":")
        where = prefix[2:] if prefix.startswith("//") else current
        found = labels.where((package == where) & name.startswith(start))
        shown = F.concat(F.lit(":"), name) if typed.startswith(":") else label_of(package, name)
        return found.select(shown.alias("completion")).distinct().orderBy("completion")
    typed = typed if typed.startswith("//") else f"//{current}"
    parent, start = typed[2:].rpartition("/")[0], typed[2:].rpartition("/")[2]
    base = f"{parent}/" if parent else ""
    below = labels.where(package.startswith(base + start)).select(package, F.substring(package, len(base) + 1, 1 << 20).alias("rest"))
    child = F.split("rest", "/")
    dirs = below.where("rest <> ''").select(F.concat(F.lit(f"//{base}"), child[0]).alias("completion"), (F.size(child) > 1).alias("deeper"))
    dirs = dirs.groupBy("completion").agg(F.max("deeper").alias("deeper"))
    shown = dirs.select(F.explode(F.when(F.col("deeper"), F.array(F.concat("completion", F.lit("/")), F.concat("completion", F.lit("/...")))).otherwise(F.array("completion"))).alias("completion"))
    whole = labels.where(package == typed[2:].removesuffix("/")).select(label_of(package, name).alias("completion"))
    return shown.unionByName(whole).distinct().orderBy("completion")
