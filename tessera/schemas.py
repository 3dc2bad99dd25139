"""Canonical schemas, as DDL."""

TILES = "x long, y long, col int, row int, core_x0 long, core_x1 long, core_y0 long, core_y1 long, edge_top boolean, edge_bottom boolean, edge_left boolean, edge_right boolean"
INSTANCES = "tile_x long, tile_y long, id long, area long, cy double, cx double, y0 int, x0 int, y1 int, x1 int"
DOTS = "tile_x long, tile_y long, cell_id long, dot_type string, y double, x double, radius double, area int, solidity double, score double"
CELLS = (
    "tile_x long, tile_y long, cell_id long, centroid_x double, centroid_y double, is_her2_positive boolean, her2_dot_count int, cep17_dot_count int, "
    "her2_cep17_ratio double, is_amplified boolean, score double, blue_region_count int, excluded boolean, exclusion_reason string"
)
PIXELS = "height int, width int, nChannels int, data binary"
