"""DataFrame operators on stacks, block grids and coordinate tables."""
