"""Python source corpora built by Spark from the driver tables.

``python_corpus`` derives one module per ``part`` row (key ``k = p_partkey``),
so its size grows with the table. Blocks of five keys form import rings (even
blocks) or chains (odd blocks); every 50th module ends in a syntax error.

``synthetic_project`` is the benchmark-style generator: ``n`` files with
``lines // 10`` functions each and comment padding, file ``i > 0`` importing
``file_0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

NL = "\n"


def _s(c: Column) -> Column:
    return c.cast("string")


def import_target(k: Column, mx: Column) -> Column:
    """Module key imported by module ``k`` or NULL: even block -> next in ring,
    odd block -> next in chain (last of the block imports nothing)."""
    b = F.floor(k / 5)
    i = k % 5
    ring = F.when((b % 2 == 0) & (b * 5 + 4 <= mx), b * 5 + (i + 1) % 5)
    chain = F.when((b % 2 == 1) & (i < 4) & (k + 1 <= mx), k + 1)
    return F.coalesce(ring, chain).cast("long")


def _parallelism(spark: SparkSession) -> int:
    """Cores of the cluster (classic sessions); the shuffle width otherwise
    (Spark Connect sessions have no SparkContext)."""
    try:
        return max(1, int(spark.sparkContext.defaultParallelism))
    except Exception:  # noqa: BLE001 - Spark Connect
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


#: Files of a partition, at most: what a task reads and keeps of the parsed corpus.
PARTITION_FILES = 5_000


def _dealt(rows: DataFrame, key: str, number: int) -> DataFrame:
    """The keys dealt over every core, and over more partitions if ``number``
    files ask for them. Parsing costs far more per row than scanning; an explicit
    partition count is not coalesced away by AQE."""
    return rows.select(key).repartition(max(_parallelism(rows.sparkSession) * 2, -(-number // PARTITION_FILES)), key)


def python_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(project, path, text, k)`` -- one generated module per part row."""
    part = table(spark, sf_dir, "part")
    mx = part.select(F.max("p_partkey")).scalar()
    part = _dealt(part, "p_partkey", part.count())
    k = F.col("p_partkey")
    d = import_target(k, mx)
    imp = F.element_at(F.array(*[F.lit(m) for m in ("os", "json", "pandas", "numpy")]), (k % 4 + 1).cast("int"))
    text = F.concat(
        F.lit('"""Module '), _s(k), F.lit('."""' + NL),
        F.lit("import "), imp, F.lit(NL),
        F.when(d.isNotNull(), F.concat(F.lit("from m"), _s(d), F.lit(" import f"), _s(d), F.lit(NL))).otherwise(F.lit("")),
        F.lit(NL + NL),
        F.lit("class C"), _s(k), F.lit(":" + NL),
        F.lit("    size: int = "), _s(k % 7), F.lit(NL + NL),
        F.lit("    def g(self, x: int) -> str:" + NL + "        return str(x)" + NL + NL + NL),
        F.lit("def f"), _s(k), F.lit("(a: int, b=1) -> int:" + NL),
        F.lit('    """Return a."""' + NL),
        F.when(k % 3 == 0, F.lit("    print(a)" + NL)).otherwise(F.lit("    assert a" + NL)),
        F.lit("    return a" + NL),
        F.when(k % 50 == 49, F.lit("def broken(" + NL)).otherwise(F.lit("")),
    )
    return part.select(
        F.concat(F.lit("proj"), _s(F.floor(k / 5) % 10)).alias("project"),
        F.concat(F.lit("m"), _s(k), F.lit(".py")).alias("path"),
        text.alias("text"),
        k.alias("k"),
    )


def synthetic_project(spark: SparkSession, n_files: int, lines_per_file: int, project: str = "bench") -> DataFrame:
    """Benchmark corpus: ``lines // 10`` functions per file, each with a
    docstring and body, padded with comments to about ``lines`` lines."""
    n_funcs = max(1, lines_per_file // 10)
    i = F.col("id")
    funcs = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_funcs - 1)),
            lambda j: F.concat(
                F.lit("def func_"), _s(j), F.lit("(x: int, y: str = 'a') -> int:" + NL),
                F.lit('    """Function '), _s(j), F.lit('."""' + NL),
                F.lit("    total = x" + NL + "    for _ in range(3):" + NL + "        total += 1" + NL + "    return total" + NL + NL),
            ),
        ),
        "",
    )
    pad = F.array_join(F.array_repeat(F.lit("# padding comment"), max(0, lines_per_file - n_funcs * 7)), NL)
    text = F.concat(
        F.lit('"""Generated module."""' + NL + "import os" + NL),
        F.when(i > 0, F.lit("from file_0 import func_0" + NL)).otherwise(F.lit("")),
        F.lit(NL), funcs, pad, F.lit(NL),
    )
    return spark.range(n_files).select(
        F.lit(project).alias("project"),
        F.concat(F.lit("file_"), _s(i), F.lit(".py")).alias("path"),
        text.alias("text"),
    )


#: Files of one layout project; ``{s}`` is the project's key. All projects have
#: the same paths, so a join that forgets the project shows at once.
LAYOUT_FILES = {
    "pkg/__init__.py": "from .core import run\n",
    "pkg/core.py": 'def run(x):\n    """Run in {s}."""\n    return x\n\n\ndef outer():\n    def inner():\n        return run(1)\n    return inner()\n',
    "pkg/c1.py": "from .core import run\n",
    **{f"pkg/c{i}.py": f"from .c{i - 1} import run\n" for i in range(2, 13)},
    "app.py": "from pkg.c12 import run\n\nprint('run', obj.run, run(1))\n",
    "use.py": "import pkg.core\n\npkg.core.run(1)\n",
    "top.py": "from pkg import run as go\n\ngo(2)\n",
    # branching imports: a>d, b>c, c>d, d>b, d>c
    "a.py": "import d\n",
    "b.py": "import c\n",
    "c.py": "import d\n",
    "d.py": "import b\nimport c\n",
    # line ends of the parser that are no line feeds
    "cr.py": "import os\rprint(os.sep)\r",
    "rules.py": "from os import *\n\ntry:\n    assert x\nexcept:\n    pass\n\ntry:\n    print(1)\nexcept Exception:\n    pass\n",
}


#: Classes over several files: a diamond through a re-export and a dotted base, a
#: property, an overridden method, bases that disagree, and a circle.
CLASS_FILES = {
    "shapes/__init__.py": "from .left import Left\n",
    "shapes/base.py": (
        'class Root:\n    """Root of {s}."""\n\n    size: int = 0\n\n    def run(self, n: int) -> int:\n        """Run once."""\n        return self.step(n)\n\n'
        "    def step(self, n: int) -> int:\n        return n + self.size\n\n    @property\n    def label(self):\n        return ''\n\n    def _hidden(self):\n        pass\n"
    ),
    "shapes/left.py": "from .base import Root\n\n\nclass Left(Root):\n    def step(this, n, twice=False):\n        \"\"\"Left step.\"\"\"\n        return this.run(n)\n",
    "shapes/right.py": "import shapes.base\n\n\nclass Right(shapes.base.Root):\n    color: str = ''\n\n    def step(self, n):\n        return n\n\n    def stop(self):\n        return self.run(1)\n",
    "both.py": "from shapes import Left\nfrom shapes.right import Right\n\n\nclass Both(Left, Right):\n    def go(self):\n        return self.step(1, True) + self.stop()\n\n\nprint(Both.run, Both().go())\n",
    "user.py": "import both\n\nboth.Both.stop(None)\n",
    "odd.py": "class A:\n    def a(self):\n        pass\n\n\nclass B(A):\n    pass\n\n\nclass X(A, B):\n    pass\n\n\nclass P(Q):\n    def p(self):\n        pass\n\n\nclass Q(P):\n    pass\n",
}

#: Names that hide each other: functions of one name, accessors, class bodies,
#: comprehensions, global and nonlocal names.
SCOPE_FILES = {
    "same.py": "def f(a):\n    return b\n\n\ndef f(b):\n    return b\n",
    "access.py": "class C:\n    limit = 1\n\n    @property\n    def x(self):\n        return value\n\n    @x.setter\n    def x(self, value):\n        self.y = value\n\n    def z(self):\n        return limit\n\n    w = [limit for _ in range(limit)]\n",
    "outer.py": "import os\nimport sys\n\n\ndef a():\n    import os\n\n    def inner():\n        nonlocal n\n        n = os.sep\n        return m\n\n    n = 1\n    return inner\n\n\ndef b():\n    global m, k\n    m = 1\n    return k\n",
    "imports.py": "def one():\n    import json\n    return json\n\n\ndef one():\n    import json\n\n\ndef two():\n    return json\n",
}


#: Syntax errors with valid code between them; each on the line named.
BROKEN_FILES = {
    "three.py": (
        "import os\n\n\ndef first():\n    return 1\n\n\ndef second()\n    return 2\n\n\nclass Kept:\n    def good(self):\n        return 3\n\n    def bad(self:\n        return 4\n\n"
        "    def after(self):\n        return 5\n\n\nvalue = = 1\n\n\ndef last():\n    return os.sep\n"
    ),
    "open.py": "def one():\n    return (\n\n\ndef two():\n    '''\ndef inside():\n    '''\n    return 2\n",
    "empty.py": "def nothing():\nvalue = 1\n\n\n@decorated\ndef shown():\n    pass\n",
    "fine.py": "def fine():\n    pass\n",
}

#: A stub beside its module, and a module that lacks what is asked of it.
STUB_FILES = {
    "pkg/__init__.py": "",
    "pkg/m.py": '"""Module of {s}."""\n\n\ndef f(a):\n    """f(a, b) does."""\n    return a\n\n\nclass A:\n    def run(self):\n        pass\n' + "".join(f"\n\ndef g{k:02d}():\n    pass\n" for k in range(30)),
    "pkg/m.pyi": "def f(a: int) -> int: ...\n",
}


def file_corpus(spark: SparkSession, sf_dir: str, files: dict[str, str], prefix: str) -> DataFrame:
    """``files(project, path, text)``: the given files once for each ``supplier``
    row, whose key stands for ``{s}``."""
    suppliers = table(spark, sf_dir, "supplier")
    suppliers = _dealt(suppliers, "s_suppkey", suppliers.count() * len(files))
    s = _s(F.col("s_suppkey"))
    each = F.array(*[F.struct(F.lit(p).alias("path"), F.replace(F.lit(t), F.lit("{s}"), s).alias("text")) for p, t in files.items()])
    return suppliers.select(F.concat(F.lit(prefix), s).alias("project"), F.explode(each).alias("f")).select("project", "f.path", "f.text")


def layout_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(project, path, text)``: one project of packages, relative
    imports, a chain of 13 re-exports, dotted uses, a nested function, branching
    import cycles and carriage-return line ends for each ``supplier`` row."""
    return file_corpus(spark, sf_dir, LAYOUT_FILES, "lib")
