"""Plan helpers: range joins, stencils and fixed points, and whole pipelines."""
