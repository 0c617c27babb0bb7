"""The queries that the engine answers over the tables in a folder."""

from tickloom.registry import Registry


def registries() -> list[Registry]:
    from tickloom.plans import context, data, evidence, market, misc, more

    return [data.R, market.R, evidence.R, misc.R, more.R, context.R]
