"""Where listings lie: stations, centres of districts, distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stations, centres of districts (in the order in which they are tried) and the centre of the city, as latitude and longitude.
STATIONS = {
    "South Kensington": (51.4941, -0.1738), "Sloane Square": (51.4924, -0.1565), "Knightsbridge": (51.5015, -0.1607), "Hyde Park Corner": (51.5027, -0.1527),
    "Green Park": (51.5067, -0.1428), "Bond Street": (51.5142, -0.1494), "Notting Hill Gate": (51.5094, -0.1967), "High Street Kensington": (51.5009, -0.1925),
    "Earls Court": (51.4914, -0.1934), "Gloucester Road": (51.4945, -0.1829), "St Johns Wood": (51.5347, -0.1740), "Hampstead": (51.5566, -0.1780),
    "Baker Street": (51.5226, -0.1571), "Victoria": (51.4965, -0.1447), "Westminster": (51.5014, -0.1248), "Paddington": (51.5154, -0.1755),
}
CENTROIDS = {
    "SW1": (51.4970, -0.1400), "SW3": (51.4900, -0.1680), "SW5": (51.4920, -0.1940), "SW7": (51.4950, -0.1780), "SW10": (51.4830, -0.1820), "SW11": (51.4650, -0.1650),
    "W1": (51.5150, -0.1450), "W2": (51.5150, -0.1780), "W8": (51.5010, -0.1920), "W11": (51.5150, -0.2050), "W14": (51.4950, -0.2100),
    "NW1": (51.5350, -0.1550), "NW3": (51.5550, -0.1780), "NW8": (51.5330, -0.1750), "EC1": (51.5230, -0.1020), "EC2": (51.5180, -0.0830),
    "WC1": (51.5230, -0.1200), "WC2": (51.5110, -0.1220), "E1": (51.5150, -0.0720), "E14": (51.5070, -0.0200), "SE1": (51.5010, -0.1060),
}
CITY = (51.5074, -0.1278)
EARTH_KM = 6371.0


def known(lat: Column, lon: Column) -> Column:
    """Neither null, nor 0, which stands for missing."""
    return F.coalesce((lat != 0) & (lon != 0), F.lit(False))


def distance_km(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null where a coordinate is missing."""
    a = F.sin(F.radians(lat2 - lat) / 2) ** 2 + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon) / 2) ** 2
    return F.when(known(lat, lon), F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_KM))


def station_km(lat: Column, lon: Column) -> Column:
    return F.least(*[distance_km(lat, lon, F.lit(a), F.lit(b)) for a, b in STATIONS.values()])


def city_km(lat: Column, lon: Column) -> Column:
    return distance_km(lat, lon, F.lit(CITY[0]), F.lit(CITY[1]))


def filled(lat: Column, lon: Column, district: Column) -> tuple[Column, Column]:
    """Coordinates, where latitude is null or 0 those of the district: its own centre, else of the first that begins it, else as they were."""
    own = F.coalesce(*[F.when(district == name, F.array(*map(F.lit, at))) for name, at in CENTROIDS.items()])
    begun = reduce(lambda found, pair: F.coalesce(found, F.when(F.startswith(district, F.lit(pair[0])), F.array(*map(F.lit, pair[1])))), CENTROIDS.items(), F.lit(None).cast("array<double>"))
    centre = F.when(lat.isNull() | (lat == 0), F.coalesce(own, begun))
    return F.coalesce(centre[0], lat), F.coalesce(centre[1], lon)
