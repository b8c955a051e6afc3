"""A corpus of Python files from the part table: the key chooses the template, so SQL can say what each must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES = [
    "a = input()\nb = a\neval(b)\n",
    "import shlex\na = input()\nb = shlex.quote(a)\nos.system(b)\n",
    "a = getenv('K')\nif a:\n    c = 1\nelse:\n    c = 2\nprint(c)\n",
    "n = input()\nwhile n:\n    n = step(n)\nopen(n)\n",
    "a = input()\na += 1\nprint(a)\n",
    "class A:\n    def run(self):\n        return helper()\nclass B:\n    def run(self):\n        return 1\ndef main(x):\n    x.run()\n    x.stop()\n    print(x)\nmain(2)\n",
    "def work(m):\n    return m\ndef emit():\n    ch.basic_publish(routing_key='q', body='x')\n    sig.send(1)\nch.basic_consume(queue='q', on_message_callback=work)\nsig.connect(work)\n",
    "import os as o\nfrom subprocess import call as c\nf = o.system\nf('ls')\nc('x')\neval('1')\ngetattr(o, 'x')\npassword = 'hunter2-hunter2'\n",
    '"""Doc."""\ndef load(path: str, n=1):\n    """Inner."""\n    global seen\n    for i in range(n):\n        if i:\n            seen = i  # a comment\n    with open(path) as h:\n        return requests.get(h)\n',
    "from flask import Flask\napp = Flask('x')\n@app.route('/a', methods=['GET', 'POST'])\ndef show():\n    return 'a'\n@app.get('/b')\nasync def read():\n    await go()\n    return 1\nurlpatterns = [path('c/', views.c)]\napp.run(debug=True)\n",
]
K = len(TEMPLATES)


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, template and source of a file per part."""
    key = F.col("p_partkey")
    sources = F.array(*[F.lit(t) for t in TEMPLATES])
    # a file's parse costs far more than its bytes: small tables would else be one task
    spread = part(spark, sf_dir).select("p_partkey").repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")
    return spread.select(F.concat(F.lit("pkg/m"), key.cast("string"), F.lit(".py")).alias("file_path"), (key % K).cast("int").alias("template"), F.get(sources, (key % K).cast("int")).alias("source"))


def literal(x) -> str:
    """A DuckDB literal."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(literal(y) for y in x) + "]"
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if isinstance(x, str) else repr(x)


def values(columns: str, rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in rows) + f") AS v({columns})"


def per_template(columns: str, rows: list[tuple], select: str = "v.*, files") -> str:
    """Rows given per template (its first column), with the number of files that have it."""
    return f"SELECT {select} FROM (SELECT (p_partkey % {K})::INT AS t, count(*) AS files FROM part GROUP BY 1) JOIN {values(columns, rows)} ON t = template"


def template_of(path: str = "file_path"):
    """The template's number from a path."""
    return (F.regexp_extract(path, r"m(\d+)\.py", 1).cast("long") % K).cast("int")
