"""Requests: the plan envelope, selectors and changes."""

from .envelope import Plan
from .requests import GetCount, GetMany, GetOne, GetPage, Page, ReadRequest, WriteChange, WriteRequest, change, selector

__all__ = ["GetCount", "GetMany", "GetOne", "GetPage", "Page", "Plan", "ReadRequest", "WriteChange", "WriteRequest", "change", "selector"]
