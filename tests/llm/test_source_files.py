import pytest

from quarrymill.llm import source_files as S

HAND = "package ledger\n\nfunc {n}(a int) int {{\n\t// keep the order\n\tif a > {k} {{\n\t\treturn a - {k}\n\t}}\n\treturn helper(a, \"x\")\n}}\n\ntype Thing struct {{\n\tName string\n\tSize int\n}}\n"
FOREIGN = "func tidy(items []Row) []Row {\n\tout := items[:0]\n\tfor _, it := range items {\n\t\tif it.Owner != \"\" {\n\t\t\tout = append(out, it)\n\t\t}\n\t}\n\treturn out\n}\n"


def row(path, content, kind="code", sid=None, ordinal=0):
    sid = sid or path
    return (f"{sid}::{ordinal}", sid, path, ordinal, kind, content)


def classify(spark, rows):
    df = spark.createDataFrame(rows, "id string, source_id string, rel_path string, ordinal int, kind string, content string").selectExpr("*", "1 as project", "'x' as body", "true as declared", "'n' as namespace")
    return {r["source_id"]: r["reason"] for r in S.classify_source_files(df).collect()}


def test_kinds(spark):
    p = "gitlab/core/ledger/code/"
    rows = [
        row(p + "a.go", HAND.format(n="one", k=3)),
        row(p + "generated_totals.go", "// rows marked as auto-generated are skipped below\n" + HAND.format(n="two", k=4)),
        row(p + "vendor/orders.go", "// writes the 'DO NOT EDIT' banner\n" + HAND.format(n="three", k=5)),
        row(p + "gen.go", "// Code generated by x. DO NOT EDIT.\n" + HAND.format(n="four", k=6)),
        row(p + "m.js", "```js\n" + "var a=b(1),c=void 0;function d(e,f){return e&&f[2]||d.e}" * 12 + "\n```"),
        row(p + "rows.py", "ROWS = [\n" + "\n".join(f'    ["x{i}", {i}, {i / 7:.4f}],' for i in range(30)) + "\n]"),
        row(p + "font.ts", 'export const f = "' + "Qx9/" * 300 + '";'),
        row(p + "dto.ts", "\n".join(f"export interface A{i} {{\n  a{i}Id?: string;\n  a{i}Ref?: string;\n}}" for i in range(12))),
        row("gitlab/core/a/code/third_party/tidy/t.go", FOREIGN),
        row("gitlab/core/b/code/util/t.go", "// a comment of its own\n" + FOREIGN),
        row("gitlab/core/c/code/util/t.go", FOREIGN.replace("\t", "    ")),
        row(p + "lib.go", "// tidy v1.2.3 | (c) 2020 the tidy authors | permissive licence\n\nfunc other() int { return 1 }"),
        row(p + "min.js.go", "package ledger\n\nvar long = \"" + "some words and more " * 40 + "\"\n" + HAND.format(n="five", k=7)[16:]),
        row("gitlab/core/ledger/docs/a.md", "// Code generated by x"),
    ]
    got = classify(spark, rows)
    assert got == {
        p + "a.go": None, p + "generated_totals.go": None, p + "vendor/orders.go": None, p + "gen.go": "generated", p + "m.js": "minified", p + "rows.py": "data", p + "font.ts": "data", p + "dto.ts": "generated",
        "gitlab/core/a/code/third_party/tidy/t.go": "third_party", "gitlab/core/b/code/util/t.go": "third_party", "gitlab/core/c/code/util/t.go": "third_party", p + "lib.go": "third_party", p + "min.js.go": None,
    }


def test_dirty_rows(spark):
    p = "gitlab/core/ledger/code/"
    notice = "// Code generated by x. DO NOT EDIT.\nfunc a() {}"
    rows = [row(p + "n.go", None), row(p + "e.go", ""), row(p + "r.go", notice), row(p + "r.go", notice), ("x", None, p + "q.go", 0, "code", notice), ("y", "y", None, 0, "code", notice), (None, "z", p + "z.go", None, None, notice)]
    assert classify(spark, rows) == {p + "n.go": None, p + "e.go": None, p + "r.go": "generated", "z": "generated"}
    assert classify(spark, []) == {}


def test_chunks_of_one_file_add_up(spark):
    """A copy is found however its file was cut into chunks."""
    lines = FOREIGN.split("\n")
    rows = [row("gitlab/core/a/code/u/t.go", FOREIGN), row("gitlab/core/b/code/u/t.go", "\n".join(lines[:4])), row("gitlab/core/b/code/u/t.go", "\n".join(lines[4:]), ordinal=1)]
    assert set(classify(spark, rows).values()) == {"third_party"}


def test_long_lines_end():
    S.chunk_features("x = [" + "1234567890" * 20_000 + "!")
    S.chunk_features("1 " * 200_000 + "x")


def test_notices_anywhere_in_the_header():
    notice = "Code generated by x. DO NOT EDIT."
    licence = "\n".join(f"Term {i} of the licence holds for the files" for i in range(40))
    found = [
        "/*\n" + licence + "\n*/\n// " + notice,
        "/* short licence */ // " + notice,
        "/*\n   plain text of a licence\n   without stars\n   " + notice + "\n*/\nfunc a() {}",
        "\n".join("// " + x for x in licence.split("\n")) + "\n// " + notice,
        '"""' + licence + '\n"""\n# ' + notice,
        '"""\nGenerated by x.\n"""\nimport os',
        "<?php\n/**\n * " + notice + "\n */",
        '<?xml version="1.0"?>\n<!--\n  ' + notice + "\n-->",
        "'use strict';\n// " + notice,
        "/** " + notice + " */",
    ]
    assert [S.header_marks(t.split("\n"))[0] for t in found] == [True] * len(found)
    none = [
        '"""Reads the rows\nproduced by the portal and\ngenerated by the worker.\n"""\nimport os',
        "/* licence */\nfunc a() {}\n// " + notice,
        "x = '''" + notice + "'''",
        "/* The list is\n   generated from the tables. */\nfunc a() {}",
        "<?php\n$a = 1;\n// " + notice,
        "/**/ var a;\n// " + notice,
    ]
    assert [S.header_marks(t.split("\n")) for t in none] == [(False, False)] * len(none)
    assert S.header_marks(["/*! tidy v1.2 | x */"]) == (False, True)


@pytest.mark.parametrize(
    "header",
    [
        "// This file is automatically @generated by Cargo.\n// It is not intended for manual editing.",
        "# WARNING: this file is generated, DO NOT EDIT",
        "/* A lexical scanner generated by flex */",
        "// DO NOT EDIT: output of protoc",
        "/* A Bison parser, made by GNU Bison 3.8.2.  */\n/* DO NOT EDIT the output by hand; changes will be lost. */",
        "// Code generated by protoc-gen-go. DO NOT EDIT.\n// versions:",
        "# Generated by Django 4.2 on 2024-01-01",
        "/*\n * Copyright 2024\n *\n * NOTE: This class was automatically generated from api.yaml\n */",
        "-- This schema has been automatically generated",
        "# -*- coding: utf-8 -*-\n# Generated by the protocol buffer compiler.  DO NOT EDIT!",
    ],
)
def test_notices_of_common_tools(header):
    assert S.header_marks(S.unfenced(header + "\nint x = 1;"))[0]


@pytest.mark.parametrize(
    "header",
    [
        "// Parses the code generated by protoc and checks its output.",
        "# Reads what was produced by the nightly job.",
        "// Created by Ann on 3 May 2021.",
        "# This file is not generated; edit it freely.",
        "// Regenerate the fixtures with make.",
        "/* Tests for the generator. Do not edit the golden files. */",
        "# The list of hosts. Do not change the order.",
        "// Helpers for code that was generated from templates.",
    ],
)
def test_hand_written_headers_that_speak_of_tools(header):
    assert not S.header_marks(S.unfenced(header + "\nint x = 1;"))[0]


@pytest.mark.parametrize("name", ["uv.lock", "bun.lock", "pubspec.lock", "mix.lock", "Pipfile.lock", "npm-shrinkwrap.json", "Cargo.lock", "api/user.pb.go", "api/user_pb2.py", "api/user_pb2_grpc.pyi"])
def test_names_that_only_tools_give(spark, name):
    own = "package ours\n\n" + "\n".join(f"call_{w}({w})" for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta"))
    rows = [("s", "s::0", f"gitlab/g/ours/code/{name}", 0, own), ("t", "t::0", "gitlab/g/ours/code/hand.go", 0, own + "\nmore()")]
    df = spark.createDataFrame(rows, "source_id string, id string, rel_path string, ordinal int, content string")
    assert [r["source_id"] for r in S.p2_found(df).collect()] == ["s"]
