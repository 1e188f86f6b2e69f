"""Where the seven source tables come from and where results go."""

from waybill.sources.catalogue import Catalogue
from waybill.sources.tables import Sources

__all__ = ["Catalogue", "Sources"]
