"""Data model: column types, foreign-key links and row-visibility policies."""

from __future__ import annotations

from dataclasses import dataclass

DEC = "decimal(10,2)"      # money columns
MONEY = "decimal(18,2)"    # sums of money (result columns)
NTZ = "timestamp_ntz"      # zone-less timestamps, like the source tables

# The order-status whitelist of the admin status change, the
# payment methods an order may carry, and the coupon discount kinds.
ORDER_STATUSES = ("pending", "processing", "shipped", "delivered", "cancelled")
PAYMENT_METHODS = ("cod", "online")
DISCOUNT_TYPES = ("percentage", "fixed")


@dataclass(frozen=True)
class Link:
    """A foreign key: child.column -> parent.id with its ON DELETE rule."""
    child: str
    column: str
    parent: str
    on_delete: str  # 'cascade' | 'set null' | 'restrict'


# The foreign keys of the shop schema and their delete rules.
LINKS = (
    Link("cart", "user_id", "users", "cascade"),
    Link("cart", "product_id", "products", "cascade"),
    Link("orders", "user_id", "users", "cascade"),
    Link("order_items", "order_id", "orders", "cascade"),
    Link("order_items", "product_id", "products", "cascade"),
    Link("order_items", "coupon_id", "coupons", "restrict"),
    Link("wishlist", "user_id", "users", "cascade"),
    Link("wishlist", "product_id", "products", "cascade"),
    Link("categories", "parent_id", "categories", "set null"),
    Link("products", "category_id", "categories", "set null"),
    Link("addresses", "user_id", "users", "cascade"),
    Link("coupon_products", "coupon_id", "coupons", "cascade"),
    Link("coupon_products", "product_id", "products", "cascade"),
    Link("reviews", "product_id", "products", "cascade"),
    Link("reviews", "user_id", "users", "cascade"),
    Link("brand_reviews", "user_id", "users", "cascade"),
)

# Parents before children: the copy order of a migration.
COPY_ORDER = ("users", "categories", "products", "coupons", "orders", "order_items",
              "cart", "wishlist", "addresses", "coupon_products", "reviews", "brand_reviews")


@dataclass(frozen=True)
class Policy:
    """Who may see or change rows of a table for one action.

    kind: 'public' (every row), 'owner' (``user_id`` = caller), 'self'
    (``id`` = caller), 'owner_via' (the parent row reached through
    ``via`` = (child column, parent table) is owned by the caller) and
    'admin' (caller's role is admin).  A table/action without a policy
    shows nothing.
    """
    table: str
    action: str       # 'select' | 'insert' | 'update' | 'delete'
    kind: str
    via: tuple = ()


def _all(table: str, kind: str, actions=("select", "insert", "update", "delete")):
    return tuple(Policy(table, a, kind) for a in actions)


# The row-visibility rules of the shop tables.
POLICIES = (
    Policy("users", "select", "public"),
    *_all("users", "self", ("update", "delete")),
    Policy("products", "select", "public"),
    *_all("products", "admin", ("insert", "update", "delete")),
    *_all("cart", "owner"),
    *_all("orders", "owner", ("select", "insert", "update")),
    Policy("order_items", "select", "owner_via", ("order_id", "orders")),
    *_all("wishlist", "owner", ("select", "insert", "delete")),
    Policy("categories", "select", "public"),
    *_all("categories", "admin", ("insert", "update", "delete")),
    *_all("addresses", "owner"),
    Policy("coupons", "select", "public"),
    *_all("coupons", "admin", ("insert", "update", "delete")),
    Policy("coupon_products", "select", "public"),
    *_all("coupon_products", "admin", ("insert", "update", "delete")),
    Policy("reviews", "select", "public"),
    *_all("reviews", "owner", ("insert", "update", "delete")),
    Policy("brand_reviews", "select", "public"),
    *_all("brand_reviews", "owner", ("insert", "update", "delete")),
)
