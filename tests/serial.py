"""An independent, one-event-at-a-time model of the apply path, used only to check the replay."""

from __future__ import annotations

import hashlib

NAMES = {
    "salesforce": ["first_name", "last_name", "email", "phone", "company"],
    "hubspot": ["firstName", "lastName", "emailAddress", "phoneNumber", "organization"],
}
F5 = ["first_name", "last_name", "email", "phone", "company"]


def fp(f):
    return hashlib.sha256("|".join(f"{k}={f[k]}" for k in F5).encode()).hexdigest()


def made_id(tenant, entity_id, target):
    return target + "-" + hashlib.sha256(f"{tenant}:customer:{entity_id}:{target}".encode()).hexdigest()[:24]


class Model:
    def __init__(self, policies):
        self.policies = sorted(policies, key=lambda p: p["created_at"])
        self.records, self.written, self.claimed = {}, {}, set()
        self.outcomes, self.changes, self.conflicts, self.clock = [], [], {}, 0

    def run(self, events):
        for e in sorted(events, key=lambda e: (e["arrival_seq"], e["delivery"])):
            self.clock += 1
            out, ent = self.process(e)
            self.outcomes.append((e["arrival_seq"], e["delivery"], e["event_id"], out, ent))
        return self

    def process(self, e):
        t, src = e["tenant_id"], e["source"]
        if (t, src, e["event_id"]) in self.claimed:
            return "duplicate", None
        pols = [p for p in self.policies if p["tenant_id"] == t and p["source"] == src and p["enabled"]]
        if not pols:
            return "no_policy", None
        if e["event_type"] == "deleted":
            out = self.delete(e, pols)
        else:
            data = e["payload"]["fields"]
            if not data:
                return "failed", None
            if any(not data.get(n) for n in NAMES[src][:3]):
                return "failed", None
            out = self.upsert(e, pols, {k: data.get(n) or "" for k, n in zip(F5, NAMES[src])})
        self.claimed.add((t, src, e["event_id"]))
        return out

    def by_id(self, t, src, pid):
        return next((r for (rt, _), r in self.records.items() if rt == t and r["ids"].get(src) == pid), None)

    def by_mail(self, t, mail):
        hits = [r for (rt, _), r in self.records.items() if rt == t and not r["tomb"] and r["f"]["email"] == mail]
        return min(hits, key=lambda r: r["created"], default=None)

    def upsert(self, e, pols, f):
        t, src, v = e["tenant_id"], e["source"], e["source_version"]
        r = self.by_id(t, src, e["entity_id"])
        if r is None:
            r = self.by_mail(t, f["email"])
            if r is not None:
                r["ids"][src] = e["entity_id"]
        new = r is None
        if new:
            r = {"id": e["entity_id"], "f": {}, "prov": {}, "sv": {}, "ids": {src: e["entity_id"]}, "tomb": False, "version": 0}
        ent = None if new else r["id"]
        if v <= r["sv"].get(src, 0):
            return "stale", ent
        if self.written.get((t, r["id"], src)) == fp(f):
            return "echo", ent
        strat, prio = pols[0]["conflict_strategy"] or "last_write_wins", pols[0]["source_priority"]
        clash = [k for k in sorted(F5) if k in r["prov"] and r["prov"][k][0] != src and r["f"][k] != f[k]]
        if clash:
            a = r["prov"][clash[0]]
            key = (t, r["id"], a[0], src, a[1], v)
            status = "CONFLICT_PENDING" if strat == "manual" else "AUTO_RESOLVED"
            self.conflicts.setdefault(key, status)
            if strat == "manual":
                return "parked", ent
        merged, prov = dict(f), {k: (src, v, e["occurred_at"], prio) for k in F5}
        for k in clash:
            a = r["prov"][k]
            later, ahead, lower = e["occurred_at"] > a[2], e["occurred_at"] == a[2], prio < a[3]
            wins = (lower or (prio == a[3] and later)) if strat == "source_priority" else (later or (ahead and lower))
            if not wins:
                merged[k], prov[k] = r["f"][k], a
        for p in pols:
            d = p["destination"]
            op = "update" if r["ids"].get(d) else "create"
            r["ids"].setdefault(d, made_id(t, r["id"], d))
            self.changes.append((e["event_id"], d, op, r["ids"][d], fp(merged)))
            self.written[(t, r["id"], d)] = fp(merged)
        r.update(f=merged, prov=prov, tomb=False, version=r["version"] + 1)
        r["sv"][src] = v
        if new:
            old = self.records.get((t, r["id"]))
            r["created"] = old["created"] if old else (e["received_at"], e["arrival_seq"])
            self.records[(t, r["id"])] = r
        return "applied", r["id"]

    def delete(self, e, pols):
        t, src = e["tenant_id"], e["source"]
        r = self.by_id(t, src, e["entity_id"])
        if r is None or r["tomb"]:
            return "noop_delete", r and r["id"]
        for p in pols:
            if p["delete_policy"] == "propagate" and r["ids"].get(p["destination"]):
                self.changes.append((e["event_id"], p["destination"], "delete", r["ids"][p["destination"]], ""))
        r["tomb"], r["version"] = True, r["version"] + 1
        r["sv"][src] = e["source_version"]
        return "deleted", r["id"]
