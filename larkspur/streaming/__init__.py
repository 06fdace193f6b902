"""Streams: nothing that this library computes is defined on a stream, so there is nothing here.

Event tables by time are sums, though, so a stream of subjects can be added up batch by batch
(``foreachBatch``) and passed to the estimators in ``larkspur.operators.survival``.
"""
