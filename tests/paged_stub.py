"""A service for the paged source, where workers can import it."""

#: Hits of the register below, and the most that it serves of a query.
SERVED = 5000


def fetch(query, start, size):
    return {"hits": 250, "items": [{"n": i} for i in range(start, min(start + size, 250))]}


def register(query):
    """Numbers of the entities that a query finds: 20,000 in all, a district with most of them, one kind of these with most of it."""
    wanted = dict(p.split("=") for p in query.split("&"))
    out = []
    for n in range(20_000):
        district = "d0" if n % 10 else f"d{n // 10 % 7}"
        kind, year = "k0" if n % 5 else f"k{n % 3}", f"y{n % 11}"
        if all({"district": district, "kind": kind, "year": year}[k] == v for k, v in wanted.items()):
            out.append(n)
    return out


def count(query):
    return len(register(query))


def search(query, start, size):
    found = register(query)
    return {"hits": len(found), "items": [{"n": n} for n in found[start : min(start + size, SERVED)]]}
