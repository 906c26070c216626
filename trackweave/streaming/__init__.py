"""The ordered operators over streams."""
