"""Queries over the driver's tables, one per operator, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.plans import catalogue, cleaning, corridors, dedupe, geometry, journeys, links, mileage, network, places, regions, roads, routes, stitching

MODULES = (geometry, catalogue, journeys, places, links, network, roads, routes, corridors, cleaning, regions, dedupe, mileage, stitching)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
