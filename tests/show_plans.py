"""Print the physical plans of the key operators (sf0.01) as Markdown."""

import re
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from fieldmodes.operators import grid as gd, ingest as ig, preprocess as pp, reshape as rs, stats as st  # noqa: E402
from fieldmodes.operators import factorize as fz  # noqa: E402
from fieldmodes.plans import catalog as cat, fixtures as fx  # noqa: E402
from fieldmodes.session import get_session, scratch_path  # noqa: E402
from fieldmodes.sources import readers as rd, writers as wr  # noqa: E402

spark = get_session("local[8]", 8)
SF = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"


def plan(df):
    txt = df._jdf.queryExecution().executedPlan().toString()
    txt = re.sub(r"#\d+L?", "", txt)
    txt = re.sub(r"\[plan_id=\d+\]", "", txt)
    txt = re.sub(r"file:[^,\]]*", "file:...", txt)
    return "\n".join(line[:160] for line in txt.splitlines())


def show(title, note, df):
    print(f"## {title}\n\n{note}\n\n```\n{plan(df)}\n```\n")


print("# Physical plans of the key operators (sf0.01, local[8])\n")
print("Generated by `python tests/show_plans.py`. Expression ids and paths are elided.\n")
mat, co, n = fx.matrix(spark, SF, "part_year", "null")
show("Pivot (C1), triplets from a groupBy", "One exchange after the triplet aggregation; the measured column order "
     "is a local relation, broadcast.", mat)
show("hconcat (C3)", "The union keeps the pieces' row_id hash partitioning: the glue groupBy adds no exchange.",
     rs.hconcat(cat._hconcat_pieces(spark, SF)))
p = scratch_path(spark, "plans")
wr.write_triplets(fx.triplets_supplier_year(spark, SF), p, block_size=4)
show("Triplet text scan with block selection (A1, B1)", "`PartitionFilters` on `record_block` prune folders; "
     "parsing is JVM-side `split` + `try_cast`.", rd.read_triplets(spark, p, blocks=[499]))
t = fx.triplets_supplier_year(spark, SF)
show("Scan pruning", "Only the three needed lineitem columns are read (`ReadSchema`).", t)
m, nr, nc = st.materialize_dims(pp.preprocess(fx.matrix(spark, SF, "supplier_year")[0], "center").mat)
res = fz.eof_exact(m, 3, n_rows=nr, n_cols=nc)
show("U = A V / sigma (F1/F3)", "A narrow `MapInArrow` over the cached matrix; no exchange.", res.u)
grid = gd.attach_loc_ids(cat._grid(spark, SF), ig.assign_loc_ids(
    fx.matrix(spark, SF, "part_year", "drop_row")[0].select(F.col("row_id").alias("cell_id"))))
show("Dense location ids (B3) and grid join (C7)", "Numbering reads the checkpointed range-sorted cells and "
     "joins a broadcast of per-partition offsets (one row per partition).", grid)
