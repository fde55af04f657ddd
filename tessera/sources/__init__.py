"""Formats: GeoJSON, layer metadata, quantized meshes, 3D tile trees, binary glTF; and sinks."""
