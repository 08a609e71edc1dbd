"""Adapters that turn files and frames into the typed frame the engine works on."""
