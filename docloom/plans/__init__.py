"""Registered queries by area."""

from __future__ import annotations

import importlib

AREAS = ("web", "files", "markup", "transcripts", "cells", "layout", "forms", "packages", "revisions", "invoices", "usage", "streams")


def registries():
    for area in AREAS:
        try:
            yield importlib.import_module(f"docloom.plans.{area}").R
        except ModuleNotFoundError as e:
            if f"docloom.plans.{area}" not in str(e):
                raise
