"""fieldmodes — leading spatial/temporal patterns (EOF / PCA) of large
observation fields, built on Spark DataFrames.

Data model (all distributed):
  triplets(row_id BIGINT, record_id, value DOUBLE)   long / COO form
  rowmat(row_id BIGINT, vector ARRAY<DOUBLE>)         wide row-matrix form
  col_order(col_pos INT, record_id)                   column index
Only column-sized blocks (m x r) and small squares reach the driver.
"""

from fieldmodes.session import get_session, scratch_path  # noqa: F401
from fieldmodes.operators.reshape import (  # noqa: F401
    column_order, dense_index, hconcat, pivot_components, pivot_rows, transpose, unpivot_rows)
from fieldmodes.operators.stats import frobenius2, low_std_rows, matrix_dims, row_mean_std, row_means  # noqa: F401
from fieldmodes.operators.preprocess import center_rows, preprocess, standardize_rows, weight_rows  # noqa: F401
from fieldmodes.operators.products import (  # noqa: F401
    cov_multiply, gram, left_multiply, multiply, right_multiply, tsqr)
from fieldmodes.operators.factorize import (  # noqa: F401
    EOFResult, compute_eofs, describe_eofs, eof_exact, eof_randomized, project_spatial, to_eofs, top_eigenpairs)
from fieldmodes.operators.evaluate import compare_factors, sse  # noqa: F401
from fieldmodes.operators.gapfill import dineof_fill  # noqa: F401

__all__ = [
    "get_session", "scratch_path",
    "column_order", "dense_index", "hconcat", "pivot_components", "pivot_rows", "transpose", "unpivot_rows",
    "frobenius2", "low_std_rows", "matrix_dims", "row_mean_std", "row_means",
    "center_rows", "preprocess", "standardize_rows", "weight_rows",
    "cov_multiply", "gram", "left_multiply", "multiply", "right_multiply", "tsqr",
    "EOFResult", "compute_eofs", "describe_eofs", "eof_exact", "eof_randomized", "project_spatial", "to_eofs",
    "top_eigenpairs", "compare_factors", "sse", "dineof_fill",
]
