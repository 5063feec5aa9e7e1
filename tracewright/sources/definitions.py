"""Workspace definitions as graph nodes: JSON, YAML, annotated make files and scripts.

Definition files are read whole and in parallel; one file is one record. Formats that need an evaluator of their own
are taken as pre-rendered JSON.
"""

from __future__ import annotations

import fnmatch
import itertools
import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.labels import format_label, parse_label
from tracewright.schemas import NODES
from tracewright.sources.files import contents

try:
    import yaml
except ImportError:  # only YAML and annotations need it
    yaml = None

#: The line that opens an annotation block, and the endings of annotated scripts.
MARKER, SCRIPTS = "# @target", (".target.sh", ".target.py")
NAMES = {"BUILD.json": "json", "BUILD.yaml": "yaml", "BUILD.yml": "yaml", "Makefile": "make"}


class DefinitionError(ValueError):
    """A definition file that cannot be read."""


def _load_yaml(text: str) -> dict:
    if yaml is None:
        raise DefinitionError("YAML support is not installed")
    return yaml.safe_load(text) or {}


def _blocks(text: str, marker: str) -> Iterator[tuple[dict, str]]:
    """Annotation blocks and the line that follows each."""
    lines = iter(text.splitlines())
    for line in lines:
        if not line.strip().startswith(marker):
            continue
        notes: list[str] = []
        for after in lines:
            bare = after.strip()
            if bare.startswith("#"):
                notes.append(bare[1:])
            elif bare:
                yield _load_yaml("\n".join(notes)), bare
                break


def parse(path: str, text: str, marker: str = MARKER, scripts: tuple[str, ...] = SCRIPTS, names: dict[str, str] = NAMES) -> dict:
    """One file -> {"targets": [...], "aliases": [...], "resources": [...], "default_platforms": [...]}."""
    name = posixpath.basename(path)
    kind = next((k for pattern, k in names.items() if fnmatch.fnmatchcase(name, pattern)), None) or ("script" if name.endswith(scripts) else None)
    try:
        if kind == "json":
            return json.loads(text)
        if kind == "yaml":
            return _load_yaml(text)
        if kind == "make":
            targets = []
            for note, line in _blocks(text, marker):
                if ":" not in line:
                    raise DefinitionError(f"{path}: expected a make target after the annotation, got {line!r}")
                rule = line.split(":")[0]
                targets.append({k: note[k] for k in ("dependencies", "inputs", "outputs", "oci_push", "tags") if k in note} | {"name": note.get("name") or rule, "command": f"make {rule}"})
            return {"targets": targets}
        if kind == "script":
            note = {}
            for note, _ in _blocks(text, marker):  # noqa: B007  the last one counts
                pass
            first = lambda x, more: [x, *[y for y in more or [] if y != x]]
            keep = {k: note[k] for k in ("dependencies", "fingerprint", "environment_variables", "timeout", "platforms") if k in note}
            return {"targets": [keep | {"name": note.get("name") or name, "inputs": first(name, note.get("inputs")), "tags": first("no-cache", note.get("tags")), "bin_output": name}]}
    except (ValueError, AttributeError) as e:
        raise DefinitionError(f"{path}: {e}") from e
    except Exception as e:
        if yaml is not None and isinstance(e, yaml.YAMLError):
            raise DefinitionError(f"{path}: {e}") from e
        raise
    return {}


def _output(text: str | None) -> dict | None:
    if not text:
        return None
    kind, sep, ident = text.partition("::")
    return {"type": kind, "identifier": ident} if sep else {"type": "file", "identifier": text}


def to_nodes(path: str, package: dict) -> list[dict]:
    """Nodes of one definition file: labels in full, outputs parsed, the package's platforms as default."""
    folder = posixpath.dirname(path)
    full = lambda x: format_label(*parse_label(x, folder))
    out = []

    def node(kind: str, dto: dict, **more) -> None:
        name = parse_label(f":{dto.get('name') or ''}", folder)[1]
        base = dict.fromkeys(f.name for f in NODES.fields)
        out.append(base | {"label": format_label(folder, name), "package": folder, "name": name, "node_type": kind, "source_file_path": path, "dependencies": [full(d) for d in dto.get("dependencies") or []]} | more)

    for t in package.get("targets") or []:
        push = {k: [v] if isinstance(v, str) else list(v) for k, v in (t.get("oci_push") or {}).items()}
        platforms = t["platforms"] if t.get("platforms") is not None else package.get("default_platforms")
        node(
            "target", t, command=t.get("command") or "", inputs=list(t.get("inputs") or []), exclude_inputs=list(t.get("exclude_inputs") or []), outputs=[_output(o) for o in t.get("outputs") or []],
            bin_output=_output(t.get("bin_output")), tags=list(t.get("tags") or []), platforms=platforms, fingerprint=t.get("fingerprint") or {}, environment_variables=t.get("environment_variables") or {},
            oci_push=push, output_checks=[{"command": c.get("command"), "expected_output": c.get("expected_output")} for c in t.get("output_checks") or []], timeout=t.get("timeout"), concurrency_group=t.get("concurrency_group"),
        )
    for a in package.get("aliases") or []:
        node("alias", a, actual=full(a["actual"]))
    for r in package.get("resources") or []:
        node("resource", r, up=r.get("up"), down=r.get("down"), ready=r.get("ready"), timeout=r.get("timeout"), exports=r.get("exports") or {})
    return out


#: The lists of a definition file, and how many of their entries are worked on at a time.
LISTS, SLICE = ("targets", "aliases", "resources"), 1_000

_decoder, _space, _END = json.JSONDecoder(), re.compile(r"[ \t\n\r]*"), object()


def _entries(text: str, at: int) -> Iterator[tuple[object, int]]:
    """Values of the JSON array that opens at ``at``, one at a time, each with the place behind it; at last ``_END`` with the
    place behind the array."""
    skip = lambda k: _space.match(text, k).end()
    at = skip(at + 1)
    while text[at : at + 1] != "]":
        value, at = _decoder.raw_decode(text, at)
        yield value, at
        at = skip(at)
        if text[at : at + 1] == "," and text[skip(at + 1) : skip(at + 1) + 1] != "]":
            at = skip(at + 1)
        elif text[at : at + 1] != "]":
            raise json.JSONDecodeError("Expecting ',' delimiter", text, at)
    yield _END, at + 1


def _places(text: str) -> tuple[dict, dict[str, int]]:
    """A JSON object without its ``LISTS``, and where those begin. All of it is read, an entry at a time."""
    skip = lambda k: _space.match(text, k).end()
    rest, places, at = {}, {}, skip(0)
    if text[at : at + 1] != "{":
        raise json.JSONDecodeError("Expecting an object", text, at)
    at = skip(at + 1)
    while text[at : at + 1] != "}":
        key, at = _decoder.raw_decode(text, at)
        at = skip(at)
        if not isinstance(key, str) or text[at : at + 1] != ":":
            raise json.JSONDecodeError("Expecting ':' delimiter", text, at)
        at = skip(at + 1)
        rest.pop(key, None), places.pop(key, None)  # of equal keys the last one counts
        if key in LISTS and text[at : at + 1] == "[":
            places[key] = at
            for _, at in _entries(text, at):  # noqa: B007, B020
                pass
        else:
            rest[key], at = _decoder.raw_decode(text, at)
        at = skip(at)
        if text[at : at + 1] == "," and text[skip(at + 1) : skip(at + 1) + 1] != "}":
            at = skip(at + 1)
        elif text[at : at + 1] != "}":
            raise json.JSONDecodeError("Expecting ',' delimiter", text, at)
    if skip(at + 1) != len(text):
        raise json.JSONDecodeError("Extra data", text, at + 1)
    return rest, places


def slices(path: str, text: str, marker: str = MARKER, scripts: tuple[str, ...] = SCRIPTS, names: dict[str, str] = NAMES) -> Iterator[dict]:
    """What ``parse`` gives, in packages of ``SLICE`` entries at most: a JSON file's objects are never held all at once."""
    kind = next((k for pattern, k in names.items() if fnmatch.fnmatchcase(posixpath.basename(path), pattern)), None)
    if kind != "json":
        package = parse(path, text, marker, scripts, names)
        places = {}
    else:
        try:
            package, places = _places(text)
        except ValueError as e:
            raise DefinitionError(f"{path}: {e}") from e
    platforms = {k: v for k, v in package.items() if k == "default_platforms"}
    for key in LISTS:
        values = (v for v, _ in _entries(text, places[key]) if v is not _END) if key in places else iter(package.get(key) or [])
        while some := list(itertools.islice(values, SLICE)):
            yield platforms | {key: some}


def load(spark: SparkSession, root: str, marker: str = MARKER, scripts: tuple[str, ...] = SCRIPTS, names: dict[str, str] = NAMES) -> DataFrame:
    """All nodes that are defined below a folder, in files of these ``names`` (patterns by kind of definition). Labels may
    repeat; ``checks.duplicate_labels`` finds those."""
    wanted = "{" + ",".join([*names, *(f"*{s}" for s in scripts)]) + "}"
    files = contents(spark, root, wanted).select("file", F.decode("content", "UTF-8").alias("text"))
    columns = [f.name for f in NODES.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, text in zip(pdf["file"], pdf["text"], strict=True):
                for package in slices(path, text, marker, scripts, names):
                    yield pd.DataFrame({"json": [json.dumps(r) for r in to_nodes(path, package)]})

    return files.mapInPandas(run, "json string").select(F.from_json("json", NODES).alias("n")).select(*[f"n.{c}" for c in columns])


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """Pre-rendered nodes, one JSON object per line, in the NODES schema."""
    return spark.read.schema(NODES).json(path)


_STATUS = re.compile(r"^[ MADRCU?!]{2} (?:.* -> )?\"?(.+?)\"?$")


def diff_files(spark: SparkSession, names: list[str], status: list[str] = ()) -> DataFrame:
    """Output lines of a version control diff (one path each) and of a short status -> distinct (file)."""
    found = {n.strip() for n in names if n.strip()} | {m[1] for line in status if (m := _STATUS.match(line))}
    return spark.createDataFrame([(f,) for f in sorted(found)], "file string")
