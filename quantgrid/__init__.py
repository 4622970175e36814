"""Analytics over large feature-by-sample measurement tables on Spark."""

from quantgrid.model import Study, complete_grid, require_scale, scale_of, tag_scale
from quantgrid.session import ship

__all__ = ["Study", "complete_grid", "require_scale", "scale_of", "ship", "tag_scale"]
