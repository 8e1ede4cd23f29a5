from fieldmodes.functions.vector import (  # noqa: F401
    lat_weight,
    vaffine,
    vmean,
    vscale,
    vshift,
    vstd_samp,
    vsum,
    vsumsq,
)
