"""Small literal tables and files that queries on repositories, settings and payloads work on, as rows and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.repository import open_folder
from ..tables import new_path


def literal(x) -> str:
    """A value as SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list | tuple):
        return "[" + ", ".join(map(literal, x)) + "]"
    return repr(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    """Rows as a SELECT; columns as in 'name type, name type' with SQL's types."""
    cast = [c.rsplit(" ", 1) for c in columns.split(", ")]
    names = ", ".join(f"c{i}::{t} AS {n}" for i, (n, t) in enumerate(cast))
    return f"SELECT {names} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({', '.join(f'c{i}' for i in range(len(cast)))})"


#: A repository: path to content.
REPOSITORY = {
    "package.json": '{"workspaces": ["packages/*"], "dependencies": {"react": "1", "express": "2"}}\n',
    "packages/shop/package.json": '{"name": "shop"}\n',
    "packages/shop/src/cart.ts": "import { Item } from './item'\nexport interface Cart {\n  items: Item[]\n}\nexport function total(cart: Cart,\n  tax: number) {\n  return cart.items.length * tax\n}\n",
    "packages/shop/src/item.ts": "export type Item = { price: number }\nexport const price = (item: Item) => item.price\n",
    "src/index.js": "const express = require('express')\nimport { pay } from './pay/charge.js'\nconst app = express()\napp.get('/pay', pay)\n",
    "src/pay/charge.js": "export async function pay(request) {\n  return charge(request.amount)\n}\nexport function charge(amount) {\n  return amount\n}\n",
    "tools/report.py": "import os\nfrom .util import table\n\nLIMIT = 3\n\nclass Report:\n    def rows(self, first):\n        return table(first)\n",
    "tools/util.py": "def table(first):\n    return [first]\n",
    "db/schema.sql": "CREATE TABLE orders (\n  id int\n);\ncreate or replace view open_orders as select 1;\nCREATE FUNCTION due() RETURNS int;\n",
    "native/sum.c": '#include "sum.h"\n#include <stdio.h>\n// int not(int a) {\nint sum(int a, int b) {\n  if (a) {\n  }\n  return a + b;\n}\n',
    "lib/core.rs": "use std::io;\npub struct Core;\nimpl Core {\n  pub fn new(size: usize) -> Core {\n    Core\n  }\n}\n",
    "app/Main.java": "import java.util.List;\npublic class Main {\n  public static void main(String[] args) {\n    run(args);\n  }\n}\n",
    "scripts/run.sh": "source ./env.sh\nstart() {\n  echo hi\n}\n",
    "docs/plan.md": "# Plan\ntext on payment\n## Steps\n#### Last\n##### Deeper\n",
    "readme.md": "hello\n", "notes.txt": "not relevant\n", "node_modules/x/index.js": "x", ".env": "KEY=1\n", "src/gen/made.js": "x\n", "src/auto.js": "// Code generated, do not edit\n", "src/broken.py": "def (\n", "big.py": "x = 1\n" * 500,
}
MAX_BYTES = 2000


def folder(spark: SparkSession, files: dict[str, str], name: str) -> str:
    """Files written into a new folder that executors share."""
    root = new_path(spark, name)
    system, base = open_folder(root)
    for path, text in files.items():
        at = f"{base.rstrip('/')}/{path}"
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(at) as out:
            out.write(text.encode())
    return root


def table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)
