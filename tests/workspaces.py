"""Small workspaces as node tables."""

from __future__ import annotations

from tracewright.schemas import NODES

_BLANK = dict.fromkeys(f.name for f in NODES.fields)


def node(label, kind="target", **more):
    package, _, name = label[2:].partition(":")
    base = _BLANK | {"label": label, "package": package, "name": name, "node_type": kind, "source_file_path": f"{package}/BUILD.json".lstrip("/")}
    if kind == "target":
        base |= {"command": "run", "inputs": [], "dependencies": [], "outputs": [], "tags": [], "platforms": [], "fingerprint": {}, "output_checks": [], "oci_push": {}, "exclude_inputs": []}
    return base | more


def table(spark, nodes):
    return spark.createDataFrame([tuple(n[f.name] for f in NODES.fields) for n in nodes], NODES)


def querying():
    return [
        node("//:bin", inputs=["bin.sh"], bin_output={"type": "file", "identifier": "bin.sh"}),
        node("//package_1:bar", inputs=["source.txt", "source_2.txt"]),
        node("//package_1:foo", inputs=["source.txt"], dependencies=["//package_1:bar"], tags=["tag1"]),
        node("//package_1:foo_test", dependencies=["//package_1:foo"], tags=["tag2"]),
        node("//package_2:package_2", dependencies=["//package_1:foo"], tags=["tag1"]),
    ]


def diamond():
    return [*querying()[:3], querying()[4] | {}, querying()[3] | {}, node("//package_2:package_3", dependencies=["//package_1:foo", "//package_2:package_2"]), node("//package_2:package_4")]
