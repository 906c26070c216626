"""Writers of snapshots, GPX and GeoJSON."""
