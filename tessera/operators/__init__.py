"""Relational operators of the engine: pyramids, hierarchy joins, selection, queues, geometry, metrics, trees."""
