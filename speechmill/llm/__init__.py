"""Training-data operators; nothing outside this subpackage and its tests imports it."""
