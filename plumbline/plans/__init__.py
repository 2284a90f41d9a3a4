"""Plans and relations; importing the package registers all of them."""

from . import registry  # noqa: F401
